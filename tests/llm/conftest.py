import os

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, size int, shard string, offset int"


@pytest.fixture
def documents(spark):
    """documents with extra columns whose names the operators use inside."""

    def build(rows):
        full = [(i, t, lang, "src", len(t) if t is not None else None, 1, "x", 2, "y", 3) for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def tables(spark, tmp_path):
    """Writes frames as <folder>/<name>.parquet and returns the folder."""

    def build(**frames):
        for name, frame in frames.items():
            frame.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return build


@pytest.fixture(scope="session")
def small(spark):
    return {x: spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "benchmark", "labels", "pages", "conversations")}
