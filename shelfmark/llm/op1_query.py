"""op1: the language of every document."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.langid import identify


def op1_language(spark, sf_dir):
    arrow_rows(spark)
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
