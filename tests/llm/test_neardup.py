import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfmark.llm import neardup
from shelfmark.llm.components import components
from shelfmark.llm.dart import signature, similarity
from shelfmark.llm.neardup import near_duplicates

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def shingles(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    size = min(5, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def classes(rows):
    """Brute force: all pairs."""
    sets = [(i, t, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, ta, sa) in enumerate(sets):
        for b, (_, tb, sb) in enumerate(sets[:a]):
            common = sum((sa & sb).values())
            if (ta is not None and ta == tb) or (common and common / (sa.total() + sb.total() - common) >= 0.8):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_rest) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)]) for k, (i, *_rest) in enumerate(sets))


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    a, b = slice(0, 260), slice(30, 300)
    order_a, order_b = np.argsort(keys[a]), np.argsort(keys[b])
    exact = similarity(keys[a][order_a], wa[a][order_a], keys[b][order_b], wb[b][order_b])
    same = signature(keys[a], wa[a], 4000) == signature(keys[b], wb[b], 4000)
    assert abs(same.mean() - exact) < 0.03
    assert (signature(keys[a], wa[a], 500) == signature(keys[a][::-1], wa[a][::-1], 500)).all()
    assert len(np.unique(signature(keys[:1], np.array([0.5]), 64))) == 64


def test_signature_does_not_depend_on_the_total():
    """The same element throws the same darts in a small and in a large set."""
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shares = [(signature(keys[:n], np.ones(n), 2000) == signature(keys, np.ones(2000), 2000)).mean() for n in (500, 1000)]
    assert abs(shares[0] - 0.25) < 0.04 and abs(shares[1] - 0.5) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (200, 200)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_all_pairs(small):
    rows = [(r.doc_id, r.text) for r in small["documents"].collect()]
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(small["documents"]).collect()) == classes(rows)


@pytest.mark.parametrize("edits", [2, 5])
def test_groups_of_near_copies(documents, edits):
    """Copies with up to `edits` words replaced: most pairs are below the threshold, chains and hubs are not."""
    rng = np.random.default_rng(edits)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, edits + 1)):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((1000 - i, " ".join(words), "en"))
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(documents(rows)).collect()) == classes(rows)


def bridged(seed, two):
    """Two families of near copies (or one and a lone document) of which only one pair, far from both hubs, reaches the threshold."""
    rng = np.random.default_rng(seed % 1000)
    base = [f"s{seed}w{k}" for k in range(400)]
    spots = rng.permutation(np.arange(6, 394, 6)).tolist()
    bridge, spots = spots[:8], spots[8:]

    def edited(words, at, name):
        return [f"{name}x{k}" if k in at else w for k, w in enumerate(words)]

    ends = [base, edited(base, bridge, f"b{seed}")]
    rows = list(ends)
    for side in range(1 + two):
        hub = edited(ends[side], [spots[side]], f"h{seed}s{side}")
        rows += [hub] + [edited(hub, [spots[2 + i]], f"m{seed}s{side}i{i}") for i in range(20)]
    return [" ".join(x) for x in rows]


def test_bridges_between_first_and_second_pivots(documents):
    texts = [t for seed in (3, 8, 14, 18) for two in (False, True) for t in bridged(seed + 1000 * two, two)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    expected = classes(rows)
    assert len({c for _, c in expected}) == 8
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(documents(rows)).collect()) == expected


def family(size, edits, seed):
    """Copies of one text with up to `edits` words replaced, without the text itself."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for i in range(size):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, edits + 1)):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words), "en"))
    return rows


def test_pairs_grow_with_the_rows_of_a_family(documents, monkeypatch):
    """Large families of near copies: classes as by brute force, and compared pairs in proportion to the rows."""
    made, plain = [], neardup._checked

    def counted(pairs, sets):
        made[-1] += pairs.count()
        return plain(pairs, sets)

    monkeypatch.setattr(neardup, "_checked", counted)
    for size in (400, 800, 1600):
        rows = family(size, 5, size)
        made.append(0)
        got = sorted((r.doc_id, r.class_id) for r in near_duplicates(documents(rows)).collect())
        if size < 1600:
            assert got == classes(rows)  # recall 1 on every link that joins classes
    assert made[2] < 2.5 * made[1] < 2.5 * 2.5 * made[0]
    assert made[2] < 40 * 1600


def test_buckets_dealt_out_again_and_again(documents, monkeypatch):
    """With buckets of two at most, the large ones go through several levels."""
    settle = neardup._settled
    monkeypatch.setattr(neardup, "_settled", lambda *x: settle(*x, few=2))
    rows = family(400, 5, 7)
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(documents(rows)).collect()) == classes(rows)


def test_null_ids_are_linked_by_their_texts(documents):
    text = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(text), "en"), (None, " ".join([*text, "more"]), "en"), (None, "another text of six plain words", "en"), (4, None, "en")]
    out = near_duplicates(documents(rows).withColumn("node", F.lit(1)), keep=["node", "doc_id", "text"]).collect()
    assert sorted((r.n_links, r.first_row) for r in out if r.text and r.text.startswith("w0")) == [(1, False), (1, True)]
    assert all(r.first_row and r.n_links == 0 for r in out if not (r.text and r.text.startswith("w0")))


def test_edges(documents):
    rows = [(1, None, "en"), (2, None, "en"), (3, "", "en"), (4, "", "en"), (5, " !?", "en"), (6, "one two", "en"), (7, "One  two!", "en"),
            (8, "a " * 100_000, "en"), (9, "a " * 100_001, "en"), (9, "a " * 100_001, "en"), (10, "é e", "en")]
    out = sorted((r.doc_id, r.class_id) for r in near_duplicates(documents(rows)).collect())
    assert out == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8), (9, 8), (10, 10)]
    assert near_duplicates(documents([])).count() == 0


def test_a_group_of_singles_is_not_multiplied(documents, monkeypatch):
    """Copies with many edits from few words, which match hardly any other: rows dealt out stay in proportion to the rows."""
    made, plain = [], neardup.materialise

    def counted(frame, label, *rest):
        out = plain(frame, label, *rest)
        made.append((label, out.count() if label in ("dealt", "members", "placed") else 0))
        return out

    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 12)):
            words[at] = f"n{rng.integers(0, 3)}"
        rows.append((i, " ".join(words), "en"))
    monkeypatch.setattr(neardup, "materialise", counted)
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(documents(rows)).collect()) == classes(rows)
    assert sum(n for _, n in made) < 30 * 300


def test_blocks_count_what_weighted_sets_share():
    """All pairs of two blocks at once, repeated shingles too, against the check of single pairs."""
    rng = np.random.default_rng(12)
    sets = [(np.unique(rng.integers(0, 40, 30)).astype(np.uint64),) for _ in range(9)]
    sets = [(k, rng.integers(1, 4, len(k)).astype(np.int32)) for (k,) in sets]
    column = neardup.pa.array([k.view(np.int64).tolist() for k, _ in sets], neardup.pa.list_(neardup.pa.int64()))
    counts = neardup.pa.array([w.tolist() for _, w in sets], neardup.pa.list_(neardup.pa.int32()))
    row, keys = neardup._elements(column, counts)
    left, right = (row[row < 5], keys[row < 5]), (row[row >= 5] - 5, keys[row >= 5])
    assert neardup._common(left, right, 5, 4).tolist() == [[neardup.common_weight(*a, *b) for b in sets[5:]] for a in sets[:5]]
    both = neardup._common(left, left, 5, 5)
    assert all(both[a, b] == neardup.common_weight(*sets[a], *sets[b]) for a in range(5) for b in range(5) if a != b)
    assert neardup._joining(np.array([[0, 1], [2, 3], [1, 2], [0, 3]]), np.array([0, 1, 1, 2])) == [0, 1]
