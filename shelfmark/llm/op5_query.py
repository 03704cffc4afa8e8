"""op5: rates of all documents that bring the domains to their target shares."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.mixing import mix


def op5_mixing_rates(spark, sf_dir):
    arrow_rows(spark)
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_mixing_rates": op5_mixing_rates}
ORACLES: dict[str, str] = {}
