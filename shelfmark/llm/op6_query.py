"""op6: the main text of every page."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.htmltext import extract


def op6_main_text(spark, sf_dir):
    arrow_rows(spark)
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_main_text": op6_main_text}
ORACLES: dict[str, str] = {}
