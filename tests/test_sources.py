import hashlib
import json
import os

from pyspark.sql import functions as F

from shelfmark.functions.vocab import UNSORTED
from shelfmark.operators import changes as C
from shelfmark.operators import evaluate as G
from shelfmark.sources import readers, scan, sinks


def touch(root, *names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as handle:
            handle.write("x")


def test_scan_lists_every_file(spark, tmp_path):
    root = str(tmp_path / "drive")
    touch(root, "a.PDF", "sub/b.txt", "sub/deep/c", ".hidden/d.jpg", "e.tar.gz")
    rows = scan.scan_inventory(spark, [root]).collect()
    assert sorted(r["type"] for r in rows) == sorted(["", ".pdf", ".txt", ".jpg", ".gz"])
    assert all(not os.path.isabs(r["path"]) for r in rows) and {r["name"] for r in rows} == {"a", "b", "c", "d", "e.tar"}


def test_scoped_scan(spark, tmp_path):
    root = str(tmp_path / "drive")
    touch(root, "a.txt", ".dot.txt", "sub/b.txt", ".hid/c.txt", "10.01_Tax/d.txt")
    paths = lambda deep: sorted(r["path"] for r in scan.scoped_inventory(spark, root, deep).collect())
    assert paths(True) == ["a.txt", "sub/b.txt"] and paths(False) == ["a.txt"]


def test_observe_and_extract(spark, tmp_path):
    root = str(tmp_path / "drive")
    touch(root, "a.txt", "b.bin")
    with open(f"{root}/a.txt", "wb") as handle:
        handle.write("hé".encode() + b"\xff!")
    seen = scan.observe(spark, scan.walk(spark, [root]), root, hash_content=True)
    rows = {r["file_name"]: r for r in C.initial_load(seen).collect()}
    assert rows["b.bin"]["sha256"] == hashlib.sha256(b"x").hexdigest() and rows["b.bin"]["content_identity_status"] == "hashed"
    assert len({r["file_key"] for r in rows.values()}) == 2
    text = {os.path.basename(r["path"]): r["text"] for r in scan.extract_text(scan.walk(spark, [root]), {".bin": lambda p: "plug"}).collect()}
    assert text == {"a.txt": "hé!", "b.bin": "plug"}


def test_index_reader(spark, tmp_path):
    path = str(tmp_path / "index.json")
    good = {"description": "Bank bills.", "aliases": ["bank"], "positive_examples": ["bill.pdf"]}
    with open(path, "w") as handle:
        json.dump({"categories": {"Tax": "11.01", "Old": "12.01", UNSORTED: "80.01"}, "incubation": {},
                   "profiles": {"Tax": good, "Old": "just a string", "Ghost": good}}, handle)
    rows = {r["category"]: r for r in readers.read_index(spark, path).collect()}
    assert set(rows) == {"Tax", "Old", UNSORTED} and [rows[c]["cat_ord"] for c in ("Tax", "Old", UNSORTED)] == [0, 1, 2]
    assert rows["Tax"]["profile"]["aliases"] == ["bank"] and rows["Old"]["profile"] is None
    assert rows[UNSORTED]["profile"]["aliases"][0] == "unsorted"


def test_csv_noise_cases_and_aliases(spark, tmp_path):
    csv = str(tmp_path / "inv.csv")
    with open(csv, "w") as handle:
        handle.write('path,name,type\n"a/b ""c"", d.txt","b ""c"", d",.txt\n')
    assert readers.read_inventory_csv(spark, csv).first()["path"] == 'a/b "c", d.txt'
    noise = str(tmp_path / "noise.json")
    with open(noise, "w") as handle:
        json.dump({"global_stopwords": ["Your"], "format_terms": ["ico"]}, handle)
    got = readers.read_noise(spark, noise)
    assert "your" in got.stopword and "ico" in got.format and "pdf" in got.format
    cases = str(tmp_path / "cases.jsonl")
    with open(cases, "w") as handle:
        handle.write(json.dumps({"current_name": "n", "parent_path": "p", "extension": "", "text_excerpt": "x"}) + "\n\n")
    assert readers.read_cases(spark, cases).first()["text"] == "n p x"
    alias = str(tmp_path / "alias.json")
    with open(alias, "w") as handle:
        json.dump({"_comment": "no data", "A": "B"}, handle, indent=1)
    assert [tuple(r) for r in readers.read_aliases(spark, alias).collect()] == [("A", "B")]


def test_event_export_is_idempotent(spark, tmp_path):
    events = spark.createDataFrame([(1, "x"), (2, "y")], "event_id long, event_type string")
    log = str(tmp_path / "log")
    sinks.export_events(events, events.limit(0), log)
    done = spark.read.schema(events.schema).json(log)
    sinks.export_events(events.unionByName(spark.createDataFrame([(3, "z")], events.schema)), done, log)
    assert sorted(r["event_id"] for r in spark.read.json(log).collect()) == [1, 2, 3]


def test_writers(spark, tmp_path):
    plan = spark.createDataFrame([("a", "10.01_Tax"), ("b", "80.01_U")], "path string, destination string")
    sinks.write_plan(plan, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).filter("destination = '10.01_Tax'").count() == 1


def test_judge_score(spark):
    truth = spark.createDataFrame([("a", "Music", "clean"), ("b", "Music", "clean"), ("c", "Music", "clean"), ("d", UNSORTED, "unknowable"),
                                   ("e", UNSORTED, "unknowable"), ("x", "_Software_Projects", "rule-unit")], "path string, expected string, tag string")
    aliases = spark.createDataFrame([("Music_Library", "Music"), ("Photos", "Family_Photos")], "bucket string, alias string")
    got = spark.createDataFrame([("a", "Music_Library"), ("b", "Photos"), ("c", UNSORTED), ("d", UNSORTED), ("e", "Photos"), ("x", "Music_Library")],
                                "path string, bucket string")
    rows = {r["tag"]: r for r in G.judge_score(G.with_truth(got, truth, aliases)).collect()}
    a = rows["all"]
    assert (a["n"], a["correct"], a["wrong"], a["missed"], a["unsorted"], a["rule_failures"]) == (5, 2, 2, 1, 2, 1)
    assert (rows["clean"]["n"], rows["clean"]["correct"]) == (3, 1)


def test_grid_matches_direct_evaluation(spark):
    rows = [("A", [("A", 0.3), ("B", 0.27)]), ("A", [("B", 0.2), ("A", 0.1)]), (UNSORTED, [("A", 0.1)]), ("B", []), (UNSORTED, [(UNSORTED, 0.5), ("A", 0.1)])]
    df = spark.createDataFrame(rows, "expected string, candidates array<struct<category:string,score:double>>")
    for r in G.grid_search(df).collect():
        right = idle = 0
        for expected, c in rows:
            s1, s2 = (c[0][1] if c else None), (c[1][1] if len(c) > 1 else 0.0)
            topic = c[0][0] if c and s1 >= r["dense_threshold"] and s1 - s2 >= r["margin_threshold"] else UNSORTED
            right += topic == expected
            idle += topic == UNSORTED
        assert (r["accuracy"], r["unsorted_ratio"], r["top_2_recall"]) == (round(right / 5, 4), round(idle / 5, 4), 0.6)
    assert G.best_setting(G.grid_search(df)).count() == 1
