import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm.hilbert import curve_index, document_shards, write_shards
from shelfmark.llm.ordering import with_offset


def test_curve_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = curve_index(cells, bits)
        assert sorted(place.tolist()) == list(range(side**dims))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0))
        assert (steps.sum(1) == 1).all()


def test_running_sums(spark):
    rows = [(k * 7 % 101, k % 5) for k in range(1000)]
    out, total = with_offset(spark.createDataFrame(rows, "k long, w long"), ["k", "w"], "w")
    done = 0
    for r in sorted(out.collect(), key=lambda r: (r.k, r.w, r.offset)):
        assert r.offset == done
        done += r.w
    assert total == done


def test_shards_are_even_and_gapless(spark, small, tmp_path):
    docs = small["documents"]
    frame = document_shards(docs, 24, ["doc_id"])
    out = frame.toPandas()
    sizes = out.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out.rename(columns={"size": "bytes"}).assign(size=out["size"]).itertuples())
    write_shards(frame, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(out)


def test_dimensions_are_pruned(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 7).cast("string").alias("lang"),
                                      (F.col("id") % 11).cast("string").alias("source"), F.col("id").alias("doc_id"))
    out = document_shards(rows, 24, ["doc_id", "lang", "source"]).groupBy("shard").agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("s")).toPandas()
    assert (out["l"] * out["s"]).mean() < 0.5 * 77


def test_edges(documents):
    rows = [(1, None, None), (2, "", "en"), (3, "é" * 300_000, "fr"), (3, "é" * 300_000, "fr"), (None, "x", "en")]
    out = document_shards(documents(rows), 24, ["doc_id", "row"]).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(k, 0) for k in range(5)]
    assert sorted((r.size for r in out)) == [8, 8, 9, 600_008, 600_008]
    assert document_shards(documents([]), 24, ["doc_id"]).count() == 0
