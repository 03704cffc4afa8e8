"""op4: near-duplicate classes of all documents."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.neardup import near_duplicates


def op4_near_duplicates(spark, sf_dir):
    arrow_rows(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLES: dict[str, str] = {}
