import re

import duckdb
import pytest

from shelfmark.llm.decontaminate import contamination
from shelfmark.llm.op8_query import ORACLE, op8_decontamination

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items):
    windows = set()
    for item, text in items:
        words = words_of(text)
        size = min(10, len(words))
        windows |= {(item, tuple(words[k : k + size])) for k in range(len(words) - size + 1) if size}
    out = []
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for item, window in windows:
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(str(item))
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out)


def test_query_matches_oracle(spark):
    got = sorted(map(tuple, op8_decontamination(spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    assert got == sorted(con.sql(ORACLE).fetchall())


def test_against_brute_force(spark, documents):
    passage = " ".join(f"p{k}" for k in range(25))
    items = [(1, passage), (2, "short item"), (3, None), (4, "..."), (5, passage.upper() + "!"), (6, "solo"), (7, "É ß p1 p2"), (1, passage)]
    rows = [
        (1, "x " + passage + " y"), (2, passage.replace(" ", ", ")), (3, None), (4, ""), (5, "a short, ITEM b short item"), (6, "solo"),
        (7, " ".join(passage.split()[:9])), (8, " ".join(passage.split()[:10])), (9, "p0 " * 50 + passage + " " + passage), (9, "solo solo"),
        (10, "É ß p1 p2 é ß p1 p2"), (11, "filler " * 100_000 + passage), (12, "\x00short\x7fitem"),
    ]
    frame = spark.createDataFrame([(*x, "e", 1) for x in items], "item_id long, text string, size string, h int")
    out = contamination(documents([(i, t, "en") for i, t in rows]), frame).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out) == expected(rows, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in out)


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, "!!")]])
def test_nothing_to_find(spark, documents, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(documents([(1, "a b", "en"), (2, None, "en")]), frame).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in out) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert contamination(documents([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_items_keep_their_ids_after_empty_ones(spark, documents):
    """All items in one batch; two nulls, two empty items, and one-byte items beside empty ones stand before the long ones."""
    texts = [None, None, "first long item of five", "", "", "second item", "z", "", "third item", "", "q", "last item of all"]
    items = [(10 + k, t) for k, t in enumerate(texts)]
    rows = [(k, t) for k, t in enumerate(texts) if t] + [(99, " | ".join(t or "" for t in texts))]
    frame = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    out = contamination(documents([(i, t, "en") for i, t in rows]), frame).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out) == expected(rows, items)
