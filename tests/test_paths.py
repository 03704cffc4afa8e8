import math
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import text as T
from shelfmark.functions import vocab as V
from shelfmark.operators import overview as O
from shelfmark.operators import rules as R


def one(df, column, key="path"):
    return {r[key]: r[column] for r in df.collect()}


def test_stem_and_extension_follow_splitext(spark, inventory):
    names = [".bashrc", "x.", "..a.b", "a.tar.gz", "plain", "A.PDF", "...", "a b.c d"]
    got = {r["path"]: (r["stem"], r["ext"]) for r in P.with_parts(inventory(names)).collect()}
    assert got == {n: (os.path.splitext(n)[0], os.path.splitext(n)[1].lower()) for n in names}


def test_both_separators_split(spark, inventory):
    row = P.with_parts(inventory(["C:\\a//b\\c.txt"])).first()
    assert (row["dirs"], row["dir"], row["base"]) == (["C:", "a", "b"], "C:/a/b", "c.txt")


def test_junk_tiers(spark, inventory):
    """Every listed name and extension in several spellings; a safe name wins over a reviewed extension; near misses are no junk."""
    tiers = {}
    for name in V.SAFE_NAMES:
        tiers |= {name.upper(): "safe", f"{name}.odt": None}
    for ext in V.SAFE_EXT:
        tiers |= {f"cache 7{ext}": "safe", f"q{ext.upper()}": "safe", f"q{ext}x": None}
    for ext in V.REVIEW_EXT:
        tiers |= {f"run.2{ext}": "review", f"~$run{ext}": "safe", f"run{ext}.odt": None}
    assert one(inventory(list(tiers)).withColumn("t", P.junk_tier(F.col("path"))), "t") == tiers


def test_managed_folders(spark, inventory):
    names = {"42.17_Maps": True, "00.00_": True, V.REVIEW_DIR: True, V.SAFE_DIR: True, V.SOFTWARE_DIR: True, "42.17-Maps": False, "x42.17_Maps": False,
             "4.170_Maps": False, "42_17_Maps": False, "_Maps": False}
    assert one(inventory(list(names)).withColumn("m", P.is_managed(F.col("path"))), "m") == names


@pytest.mark.parametrize("dirs,depth", [
    ((), 0), (("music", "jazz", "1959"), 0), (("node_modules", "x"), 0), (("site-packages",), 0), (("shop", "site-packages"), 1),
    (("w", "shop", "NODE_MODULES", "a", "node_modules"), 2), (("w", "shop", "deep", ".GIT", "refs"), 3), (("w", "shop", ".venv", "lib64", "site-packages"), 2),
    (("w", "env", "lib", "py", "site-packages"), 1), (("tools", "py39", "LIB", "extra", "site-packages", "six"), 2), ((".env", "lib", "site-packages"), 0),
    (("w", ".git", "lib", "site-packages"), 1), (("lib", "site-packages", "a", ".git"), 3)])
def test_bundle_roots(spark, dirs, depth):
    df = spark.createDataFrame([(list(dirs),)], "dirs array<string>")
    assert df.select(P.bundle_root_depth(F.col("dirs"))).first()[0] == depth


def test_split_is_a_partition(spark, inventory):
    rng = random.Random(11)
    folders = ["shop", "shop/web", "shop/web/node_modules/q", "maps", "maps/alps", "lab/.git/refs", "lab/notes", ""]
    names = ["hike.gpx", "index.js", "run.old", "~$plan.odt", "z.pyo", "README"]
    paths = sorted({f"{rng.choice(folders)}/{rng.randrange(40)}{rng.choice(names)}".lstrip("/") for _ in range(150)})
    rows = R.split_inventory(P.with_parts(inventory(paths))).collect()
    assert sorted(r["path"] for r in rows) == paths
    for r in rows:
        unit = next((u for u in ("shop/web", "lab") if r["path"].startswith(f"{u}/")), None)
        tier = None if unit else "safe" if r["path"].endswith("z.pyo") else "review" if r["path"].endswith("run.old") else None
        assert (r["placement"], r["unit"], r["junk"]) == ("unit" if unit else "junk" if tier else "routed", unit, tier), r


def test_shallowest_unit_wins(spark, inventory):
    paths = ["a/.git/x", "a/b/node_modules/y", "a/b/z.txt", "a/b/c/.git/w"]
    rows = R.split_inventory(P.with_parts(inventory(paths))).collect()
    assert {r["unit"] for r in rows} == {"a"} or {r["path"]: r["unit"] for r in rows}["a/b/z.txt"] == "a"


def test_strip_scan_root(spark, inventory):
    def strip(paths):
        return sorted(r["path"] for r in R.strip_scan_root(inventory(paths)).collect())

    assert strip(["a/b/c.txt", "a/b/d/e.txt"]) == ["c.txt", "d/e.txt"]
    assert strip(["a/b", "a/b/c"]) == ["b", "b/c"]
    assert strip(["one/only.txt"]) == ["only.txt"]
    assert strip(["x.txt", "a/y.txt"]) == ["a/y.txt", "x.txt"]


def test_has_information(spark, inventory):
    """A path says something as soon as one run of three letters is no generic word, wherever it stands."""
    dull = sorted(V.GENERIC_WORDS)[:6]
    cases = {f"{dull[0]}/{dull[1]}_{dull[2]} 77.odt": False, f"{dull[3].upper()}/12/ab-{dull[4]}.png": False, "x1/y2/zz.leek": False, "": False,
             f"{dull[0]}/leek/{dull[1]}.odt": True, f"{dull[5]}/{dull[5]}leek.odt": True, "77/Étude99abc.odt": True}
    df = P.with_parts(inventory(list(cases))).withColumn("i", P.has_information(F.col("dirs"), F.col("stem")))
    assert one(df, "i") == cases


def test_plan_text(spark, inventory):
    df = P.with_parts(inventory(["Personal\\Tax-Docs\\ITR_2021.pdf"]))
    text = lambda t: df.select(P.plan_text(F.col("dirs"), F.col("stem"), F.col("ext"), t)).first()[0]
    assert text("ext") == "ITR 2021 Personal Tax Docs pdf"
    assert text(None) == "ITR 2021 Personal Tax Docs"
    assert text("kind") == "ITR 2021 Personal Tax Docs pdf document"


def test_sanitise_topic(spark, inventory):
    cases = {"family_pdf x": "Family_Pdf_X", "A&B--c": "A_B_C", "_tax 2021b_": "Tax_2021B", "Bills_Tax": "Bills_Tax"}
    assert one(inventory(list(cases)).withColumn("s", P.sanitise_topic(F.col("path"))), "s") == cases


def test_phrases_skip_repeats(spark):
    df = spark.createDataFrame([(["a", "a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(T.phrases(F.col("t"))).collect()]
    assert got == [["a b", "b c", "a a b", "a b c"], [], []]


def test_cluster_root(spark, inventory):
    cases = {"Users/admin/Tax Docs 2021/Bank/x/y/f.pdf": "tax_docs > bank", "f.pdf": "root", "desktop/f.pdf": "root",
             "one two six/alpha/beta/gamma/f": "one_two > alpha > beta"}
    df = P.with_parts(inventory(list(cases))).withColumn("c", T.cluster_root(F.col("dirs"), T.NoiseTerms()))
    assert one(df, "c") == cases


def reference_groups(paths, big, depth=2):
    """Recursive definition of the adaptive folder groups."""
    by_key = {}
    for p in paths:
        dirs = p.split("/")[:-1]
        by_key.setdefault("\\".join(dirs[:depth]) or ".", []).append(p)
    out = {}
    for key, group in by_key.items():
        sub = reference_groups(group, big, depth + 1) if len(group) > big and depth < 5 else {}
        out.update(sub if len(sub) > 1 else {key: group})
    return out


def test_adaptive_folder_groups_match_the_recursive_definition(spark, inventory):
    rng = random.Random(5)
    paths = set()
    while len(paths) < 900:
        depth = rng.randint(0, 6)
        dirs = [rng.choice("ab") + rng.choice(["", "", "x"]) for _ in range(depth)]
        paths.add("/".join(dirs + [f"f{rng.randint(0, 10**6)}.txt"]))
    groups = O.folder_groups(P.with_parts(inventory(list(paths))), min_big=25)
    got = {r["folder"]: r["files"] for r in groups.groupBy("folder").agg(F.sum("files").alias("files")).collect()}
    want = {k: len(v) for k, v in reference_groups(sorted(paths), max(25, len(paths) // 30)).items()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_spread_sample_is_even_however_rows_are_cut(spark, ranges):
    rows = [("big", f"{i:04d}") for i in range(53)] + [("small", f"{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "g string, path string")
    got = sorted((r["g"], r["path"], r["slot"]) for r in O.spread_sample(df, "g", "path", 5, ranges).collect())
    want = [("big", f"{i * 53 // 5:04d}", i) for i in range(5)] + [("small", f"{i}", i) for i in range(3)]
    assert got == sorted(want)


def test_leftover_groups(spark, inventory):
    paths = [f"Pics/a{i}.jpg" for i in range(7)] + ["Misc/b.dat"]
    rows = P.with_parts(inventory(paths)).withColumn("candidates", F.array(F.struct(F.lit("Photos").alias("category"), F.lit(0.5).alias("score"))))
    got = {r["folder"]: r for r in O.leftover_groups(rows).collect()}
    assert {k: r["files"] for k, r in got.items()} == {"Pics": 7, "Misc": 1}
    assert got["Pics"]["closest_buckets"] == "Photos=5" and got["Misc"]["sample_names"] == "b.dat"
    assert got["Pics"]["sample_names"] == "a0.jpg;a1.jpg;a2.jpg;a4.jpg;a5.jpg"


def test_overview(spark, inventory):
    paths = [f"Study/Soil/Lec {i}.mp4" for i in range(30)] + ["Music/a.mp3", "venv/x.py", "proj/.venv/Lib/site-packages/m.py", "t.tmp"]
    split = R.split_inventory(P.with_parts(inventory(paths)))
    groups = O.folder_groups(split.filter("placement = 'routed'"))
    row = O.overview(split, groups).first()
    assert (row["files_total"], row["junk_files"], row["unit_files"], row["units"], row["needing"]) == (34, 1, 1, 1, 32)
    assert (row["target_min"], row["target_max"]) == (math.ceil(34**0.5), math.floor(6 * 1.5))
    top = O.folder_map(groups).orderBy(F.desc("files")).first()
    assert (top["folder"], top["files"], top["top_types"]) == ("Study\\Soil", 30, ".mp4=30")
    assert O.type_table(groups).orderBy(F.desc("files")).first()["type"] == ".mp4"
