"""op9: personal data in every document."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.pii import find_personal_data


def op9_personal_data(spark, sf_dir):
    arrow_rows(spark)
    return find_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op9_personal_data": op9_personal_data}
ORACLES: dict[str, str] = {}
