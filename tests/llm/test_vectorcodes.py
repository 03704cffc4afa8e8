import hashlib
import math

import numpy as np
import pytest

from shelfmark.llm.op11_query import op11_vector_codes
from shelfmark.llm.vectorcodes import decode, encode, nearest_entries, sequency_order, train, walsh

SCHEMA = "vec_id long, embedding array<float>, label int, code string, k int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """Product codes by plain loops over Python integers: {(vec_id, vector): (code, error)} and the codebooks."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v in kept), default=0)
    width = max(1, -(-longest // parts))
    whole = []
    for i, v in kept:
        ints = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]
        whole.append((i, v, ints + [0] * (parts * width - len(ints))))
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in whole[:entries]] for p in range(parts)]

    def assign(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for _, _, v in whole:
            for p in range(parts):
                groups.setdefault((p, assign(p, v)[1]), []).append(cut(v, p))
        for (p, j), members in groups.items():
            books[p][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, _, v in whole:
        found = [assign(p, v) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


def test_transform_keeps_distances_and_orders_by_sign_changes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-500, 500, (2, 40, 5))
    assert (((walsh(a) - walsh(b)) ** 2).sum(1) == 8 * ((a - b) ** 2).sum(1)).all()
    one = np.eye(8, dtype=np.int64)
    rows = walsh(one).T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(8)) and len(sequency_order(1)) == 1


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_entry_with_ties(kind):
    rng = np.random.default_rng(2)
    parts, book = rng.integers(-3, 3, (300, 3)).astype(kind), rng.integers(-3, 3, (20, 3)).astype(kind)
    index, apart = nearest_entries(walsh(parts), walsh(book))
    every = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert index.tolist() == [min(range(20), key=lambda j: (row[j], j)) for row in every.tolist()]
    assert apart.tolist() == every.min(1).tolist()


@pytest.mark.parametrize(("count", "length", "top"), [(300, 64, 1.0), (90, 40, 3.0), (40, 7, 1.0), (70, 33, 3e38)])
def test_codes_equal_plain_loops(spark, count, length, top):
    rng = np.random.default_rng(count)
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(count), rng.uniform(-top, top, (count, length)), strict=True)]
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (1000, rows[2][1][:-3]), (1001, [])]
    wanted, books = plain(rows)
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    found = train(frame)
    assert found.entries.tolist() == [[list(e) for e in book] for book in books]
    got = [(r.vec_id, r.code, r.error) for r in encode(frame, found).collect()]
    wanted = [(i, c, e if e < 1 << 63 else None) for i, c, e in wanted]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    first = wanted[0][1]
    assert decode([first], found)[0].tolist() == [x for p in range(16) for x in found.entries[p, int(first[2 * p : 2 * p + 2], 16)].tolist()]


def test_query_drops_broken_vectors_and_adds_up_labels(spark, tables):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 64))], [None, 1, 2][i % 3], "c", 1) for i in range(150)]
    bad = [(900, None, 1, "c", 1), (901, [None] * 64, 1, "c", 1), (902, [float("nan")] * 64, 2, "c", 1),
           (903, [float("inf")] + [0.0] * 63, None, None, None)]
    folder = tables(embeddings=spark.createDataFrame(good + bad, SCHEMA))
    out = op11_vector_codes(spark, folder).collect()
    wanted, books = plain([(i, v) for i, v, *_ in good])
    assert sorted((r.vec_id, r.code, r.error) for r in out) == sorted(wanted)
    label = {i: x for i, _, x, *_ in good}
    sums = {x: sum(e for i, _, e in wanted if label[i] == x) for x in (None, 1, 2)}
    assert all(r.label_error == sums[label[r.vec_id]] for r in out)
    text = ",".join(str(x) for book in books for e in book for x in e)
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


def test_no_vectors(spark, tables):
    folder = tables(embeddings=spark.createDataFrame([(1, None, 1, "c", 1), (2, [float("nan")], 1, "c", 1)], SCHEMA))
    assert op11_vector_codes(spark, folder).collect() == []
