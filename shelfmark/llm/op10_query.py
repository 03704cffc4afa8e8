"""op10: every document without later copies of repeated line runs."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.linededup import dedup_lines


def op10_line_dedup(spark, sf_dir):
    arrow_rows(spark)
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES: dict[str, str] = {}
