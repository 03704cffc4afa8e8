import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions.vocab import UNSORTED as U
from shelfmark.operators.vote import folder_vote


def vote(spark, rows, **options):
    """rows: (path, own, near, held) -> {path: topic}, moved"""
    df = P.with_parts(spark.createDataFrame(rows, "path string, own string, near string, held boolean"))
    got = folder_vote(df, **options).collect()
    return {r["path"]: r["topic"] for r in got}, sum(r["voted"] for r in got), sum(r["blocked"] for r in got)


def folder(name, files, ext="txt"):
    return [(f"{name}/f{i}.{ext}", own, near, False) for i, (own, near) in enumerate(files)]


def test_agreeing_and_mixed_folders(spark):
    topics, moved, _ = vote(spark, folder("music", [("Music", "Music")] * 5 + [(U, "Music")] * 25))
    assert moved == 25 and set(topics.values()) == {"Music"}
    assert vote(spark, folder("mix", [(U, "Music")] * 15 + [(U, "Books")] * 15))[1] == 0
    assert vote(spark, folder("tiny", [(U, "Music")] * 10))[1] == 0
    assert vote(spark, folder("odd", [(U, U)] * 30))[1] == 0
    assert vote(spark, [(f"a{i}.txt", U, "Music", False) for i in range(30)])[1] == 0


def test_deepest_clean_folder_wins(spark):
    topics, moved, _ = vote(spark, folder("lib/books", [(U, "Books")] * 25) + folder("lib/songs", [(U, "Music")] * 25))
    assert moved == 50 and topics["lib/books/f0.txt"] == "Books" and topics["lib/songs/f0.txt"] == "Music"


def test_type_check(spark):
    rows = [(f"old/song{i}.mp3", U, "Music", False) for i in range(25)] + [("old/Form 16 2019.pdf", U, "Finance", False)]
    assert vote(spark, rows, type_check=False)[1] == 26
    topics, moved, blocked = vote(spark, rows)
    assert (moved, blocked, topics["old/Form 16 2019.pdf"]) == (25, 1, U)
    rows = [(f"course/l{i}.mp4", "Code" if i < 15 else U, "Code", False) for i in range(20)]
    rows += [(f"course/l{i}.srt", "Code" if i < 5 else U, "Code", False) for i in range(10)]
    assert vote(spark, rows)[1] == 10


def test_held_files_stay_and_sorted_files_keep_their_topic(spark):
    rows = [(f"music/s{i}.mp3", U, "Music", i < 5) for i in range(25)]
    topics, moved, _ = vote(spark, rows)
    assert moved == 20 and topics["music/s0.mp3"] == U
    topics, _, _ = vote(spark, folder("m", [("Books", "Music")] * 3 + [(U, "Music")] * 27))
    assert topics["m/f0.txt"] == "Books"


def brute_force(rows, share, min_files):
    counts, support = {}, {}
    split = [(p.split("/")[:-1], "." + p.rsplit(".", 1)[1]) for p, *_ in rows]
    for (dirs, _), (_, _, near, _) in zip(split, rows):
        for d in range(1, len(dirs) + 1):
            c = counts.setdefault(tuple(dirs[:d]), {})
            c[near] = c.get(near, 0) + 1
    win = {}
    for k, c in counts.items():
        best = min(c, key=lambda n: (-c[n], n))
        if sum(c.values()) >= min_files and best != U and c[best] / sum(c.values()) >= share:
            win[k] = best
    for (dirs, ext), (_, _, near, _) in zip(split, rows):
        for d in range(1, len(dirs) + 1):
            k = tuple(dirs[:d])
            if win.get(k) == near:
                s = support.setdefault(k, {})
                s[ext] = s.get(ext, 0) + 1
    out = {}
    for (dirs, ext), (path, own, _, held) in zip(split, rows):
        out[path] = own
        if own == U and not held:
            for d in range(len(dirs), 0, -1):
                k = tuple(dirs[:d])
                if k in win:
                    if support[k].get(ext, 0) >= max(2, 0.05 * sum(support[k].values())):
                        out[path] = win[k]
                    break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_vote_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        dirs = [rng.choice("abc") for _ in range(rng.randint(0, 4))]
        near = rng.choice(["A", "A", "A", "A", "B", U]) if (dirs[:1] or ["x"])[0] != "c" else "B"
        own = near if rng.random() < 0.4 else U
        rows.append(("/".join(dirs + [f"f{i}.{rng.choice(['x', 'x', 'x', 'y', 'z'])}"]), own, near, own == U and rng.random() < 0.1))
    topics, moved, _ = vote(spark, rows, share=0.6, min_files=8)
    assert topics == brute_force(rows, 0.6, 8) and moved > 0
