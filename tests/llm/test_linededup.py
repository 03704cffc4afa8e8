import numpy as np

from shelfmark.llm.linededup import dedup_lines, shortest_runs


def brute(rows, least):
    """Deletes every run of `least` words or more that has an earlier copy, longest matches first to last."""
    rows = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: x)
    lines = [[x.strip() for x in t.split("\n")] for _, t in rows]
    out = {}
    for n, own in enumerate(lines):
        gone = set()
        for k in range(len(own)):
            for m in range(n + 1):
                for j in range(len(lines[m]) if m < n else k):
                    size = 0
                    while k + size < len(own) and j + size < len(lines[m]) and own[k + size] == lines[m][j + size]:
                        size += 1
                    if size and sum(len(x.split()) for x in own[k : k + size]) >= least:
                        gone |= set(range(k, k + size))
        out[rows[n]] = (len(own), sorted(gone), "\n".join(x for k, x in enumerate(rows[n][1].split("\n")) if k not in gone))
    return out


def test_shortest_runs():
    ahead, back = shortest_runs(np.array([3, 0, 2, 5, 1]), 5)
    assert ahead.tolist() == [3, 3, 2, 1, 0] and back.tolist() == [0, 0, 3, 1, 2]


def test_against_brute_force(documents):
    rng = np.random.default_rng(8)
    pool = ["", "a", "b c", "d e f", "g h i j k l m", "n o p q r s t u v w x y z", "  a "]
    passage = [f"line {k} of it" for k in range(12)]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 9)))) for i in range(40)]
    rows += [(100, "\n".join(passage)), (101, "x\n" + "\n".join(passage[3:9]) + "\ny"), (102, "\n".join(passage + passage[:5])), (50, "\n".join(passage[2:]))]
    for least in (1, 6, 10):
        expected = brute(rows, least)
        out = dedup_lines(documents([(i, t, "en") for i, t in rows]), least).collect()
        assert len(out) == len(rows)
        for r in out:
            text = next(t for i, t in rows if i == r.doc_id)
            n_lines, gone, kept = expected[(r.doc_id, text)]
            assert (r.n_lines, r.n_removed, r.text) == (n_lines, len(gone), kept) and (r.removed or []) == gone


def test_edges(documents):
    text = "one two three four five six seven eight nine ten\nend"
    rows = [(1, None, "en"), (2, "", "en"), (3, text, "en"), (3, text, "en"), (4, text, "en"), (5, "\n" * 50_000, "en"), (6, "w " * 200_000, "en")]
    out = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(documents(rows)).collect()), key=str)
    assert [x[:3] for x in out] == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (3, 2, 0), (4, 2, 2), (5, 50_001, 0), (6, 1, 0)]
    assert out[0][3] is None and out[2][3] == text and out[4][3] == ""
    assert dedup_lines(documents([])).count() == 0
