import hashlib

import duckdb
from pyspark.sql import functions as F

from shelfmark.llm.chat import escape, format_chats, loss_text, read_turns, unescape
from shelfmark.llm.op3_query import HARD_TEXT, ORACLE, op3_chat_format

TEXTS = ["", "plain", HARD_TEXT, "\\", "\\\\", "\\l", "\\\\l<", "a\n### User: b</turn>\n", "é中\U0001f600#<", "\\c:", "x\\\\\\#"]


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for colon in (False, True):
        out = rows.select("t", escape(F.col("t"), colon).alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
        assert all(r.t == r.u for r in out)
        assert not any(c in r.e for r in out for c in ("<#:" if colon else "<#"))


def test_turns_come_back_and_machine_validates(spark):
    chats = {
        1: [(0, "system", "s"), (1, "user", "u"), (2, "assistant", HARD_TEXT)], 2: [(0, "assistant", "a")], 3: [(0, "user", None), (1, None, "b")],
        4: [(0, "user", "x"), (0, "assistant", "y")], 5: [(0, "to:ol#", "z"), (1, "user", "z")], 6: [(0, "user", "x"), (1, "user", "x")],
    }
    rows = [(k, *t, "extra") for k, turns in chats.items() for t in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = {r.conv_id: r for r in format_chats(frame).withColumn("back", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments"))).collect()}
    for k, turns in chats.items():
        expected = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda t: (t[0], t[1] or "", t[2] or ""))]
        assert [(t.role, t.text) for t in out[k].back] == expected
        assert out[k].loss == "".join(t for r, t in expected if r == "assistant")
        assert out[k].formatted == "".join(s.text for s in out[k].segments)
    assert {k: out[k].valid for k in out} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert format_chats(frame.limit(0)).count() == 0


def test_query_matches_oracle(spark):
    got = sorted(map(tuple, op3_chat_format(spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    assert got == sorted(con.sql(ORACLE).fetchall())
    hard = next(r for r in got if r[0] == -7)
    assert hard[2] == hashlib.sha256(f"user\n{HARD_TEXT}\nassistant\n{HARD_TEXT}\n".encode()).hexdigest() and hard[6]
