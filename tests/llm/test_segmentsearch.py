import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.op12_query import op12_top_scores
from shelfmark.llm.segmentsearch import statistics, top_scores

SCHEMA = "vec_id long, embedding array<double>, label int, row long, rank int, v string"


def plain(rows, k=20, scale=64, step=20):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % step:
            continue
        found = [(sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(kept) if a != b]
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(i, n, j, s if abs(s) < 1 << 63 else None) for n, (s, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def search(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 7, 8, "x") for i, v in rows], SCHEMA).repartition(4)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in top_scores(frame, F.col("vec_id") % 20 == 0, **options).collect()), key=str)


def test_bounds_hold_at_every_resolution_and_tighten():
    rng = np.random.default_rng(0)
    a, b = np.floor(rng.normal(2, 20, (2, 200, 64)))
    bounds = [x @ y.T for x, y in zip(statistics(a), statistics(b), strict=True)]
    assert all((bound >= a @ b.T - 1e-6).all() for bound in bounds)
    assert (bounds[0] >= bounds[1] - 1e-6).all() and (bounds[1] >= bounds[2] - 1e-6).all()


@pytest.mark.parametrize("top", [1.0, 3e6, 1e30])  # products within doubles, within 64 bits, beyond
def test_equal_to_plain_search(spark, top):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, top / 4, (260, 24)).tolist()
    rows = list(enumerate(vectors)) + [(20, vectors[20]), (20, vectors[5]), (None, vectors[40]), (None, vectors[60]), (-40, vectors[7]),
                                       (500, vectors[9][:11]), (501, []), (502, None), (503, [None] * 3), (504, [float("nan")]), (505, [float("inf")])]
    assert search(spark, rows) == plain(rows)


def test_chunks_of_queries_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(rng.normal(0, 1, (200, 8)).tolist()))
    assert search(spark, rows, chunk_bytes=16 * 8 * 3, k=7) == plain(rows, k=7)


def test_many_equal_vectors_and_clusters(spark):
    """A third of all rows is one vector; the others lie in two tight clusters, where coarse bounds rule most pairs out."""
    rng = np.random.default_rng(5)
    middle = np.repeat(rng.normal(0, 3, (2, 4)), 8, axis=1)
    rows = [(i, (middle[i % 2] + rng.normal(0, 0.1, 32)).tolist()) for i in range(4000)]
    rows += [(10_000 + i, [1.5] * 32) for i in range(2000)]
    assert search(spark, rows[::5] + rows[4000::5], k=20) == plain(rows[::5] + rows[4000::5])


def test_few_rows_and_none(spark, tables):
    assert search(spark, [(20, [1.0, 2.0])]) == []
    assert search(spark, [(1, [1.0])]) == [] and search(spark, [(20, None)]) == []
    folder = tables(embeddings=spark.createDataFrame([(0, [0.5, -1.0], 1, 1, 1, "x"), (1, [0.25, 1.0], 1, 1, 1, "x"), (40, [1.0], 1, 1, 1, "x")], SCHEMA))
    assert sorted(map(tuple, op12_top_scores(spark, folder).collect())) == [(0, 1, 40, 2048), (0, 2, 1, -3584), (40, 1, 0, 2048), (40, 2, 1, 1024)]
