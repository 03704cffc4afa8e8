"""Encoded texts against their SQL, on texts that are rare in the given tables."""
import pytest

from shelfmark.operators import classify as C
from workloads import sort_queries as Q

duckdb = pytest.importorskip("duckdb")
TEXTS = ["", "-- __ ...", "One two TWO", "İstanbul IŞIK", "ΣΑΣ ΟΔΟΣ", "école ÉCOLE naïve"]


def both(spark, folder, name, texts):
    rows = [(k, t, "de" if k % 2 else "en") for k, t in enumerate(texts)]
    path = str(folder / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in Q.QUERIES[name](spark, str(folder)).collect()), key=key)
    return got, sorted(con.execute(Q.ORACLES[name]).fetchall(), key=key)


def test_documents_without_words_and_rare_capitals(spark, tmp_path):
    got, sql = both(spark, tmp_path, "cached_vectors", TEXTS + [None])
    assert got == sql and {r[1] for r in got if r[0] in (0, 1, len(TEXTS))} == {":"}


def test_entries_that_round_to_zero_are_shown(spark):
    rows = spark.createDataFrame([([1.0, 0.0, 4e-7, 6e-7],)], "vec array<double>")
    assert rows.select(Q._shown(rows.vec)).first()[0] == "0:1000000 2:0 3:1"


def test_missing_texts_are_one_and_spaces_are_those_of_sql(spark, tmp_path):
    got, sql = both(spark, tmp_path, "encoded_texts", [*TEXTS, None, None, "a\u000bb c", "\u00a0x  y\u3000", "\tx\r\n\fy_-z\u2003 "])
    assert got == sql and sum(r[0] is None for r in got) == 1


def test_a_cached_missing_text_is_not_encoded_again(spark):
    texts = spark.createDataFrame([("a b",), (None,), (None,)], "text string")
    none = spark.createDataFrame([], "model string, text_sha1 string, vec array<double>")
    cache = C.encode_new(texts, none, "m")
    assert sorted(str(r["text_sha1"]) for r in cache.collect())[1:] == ["None"] and C.encode_new(texts, cache, "m").count() == 0
    found = C.with_cached_vectors(texts, cache, "m").collect()
    assert len(found) == 3 and [sum(r["vec"]) for r in found if r["text"] is None] == [0.0, 0.0]
