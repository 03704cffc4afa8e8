"""op2: every document stored as Ogg, read back and described."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.ogg import media_features, store_media


def op2_media(spark, sf_dir):
    arrow_rows(spark)
    return media_features(store_media(table(spark, sf_dir, "documents")))


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
