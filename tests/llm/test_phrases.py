import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import phrases
from shelfmark.llm.op13_query import op13_collocations
from shelfmark.llm.phrases import POLYNOMIALS, Words, collocations

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, longest=5, least=100, top=2000, share=100):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, all_counts in counts.items():
        f = {p: a for p, a in all_counts.items() if a >= least}
        inside = Counter()
        for p, a in f.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in f.items():
            if len(p) < 2 or 100 * inside[p] >= share * a:
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, totals[lang], score))
    return sorted(out)


def mined(documents, rows, **options):
    return sorted(map(tuple, collocations(documents(rows).repartition(5), **options).collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "g", "délta", "ε", "x-y", "ALPHA", "7", "long" * 40, "\xa0odd"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", " \t "]
    out = []
    for i in range(160):
        body = "".join(rng.choice(words[: 3 + i % 8]) + rng.choice(marks) for _ in range(rng.randrange(0, 120)))
        out.append((i, body, rng.choice(["en", "de", None, "und"])))
    passage = "one very common passage of words that many texts share, in two pieces"
    out += [(500 + i, f"{passage} {i}", "en") for i in range(60)] + [(600 + i, passage, "en") for i in range(60)]
    return out + [(None, "alpha beta " * 400, "en"), (700, None, None), (701, "", "en"), (702, " ., ", "fr"), (702, "a a a a a a", "fr"), (702, "a a a a a a", "fr")]


@pytest.mark.parametrize(("least", "bits"), [(5, 62), (40, 62), (5, 7)])  # 7 bits: nearly every fingerprint is a collision
def test_equal_to_plain_counting(documents, texts, least, bits):
    assert mined(documents, texts, least=least, bits=bits) == plain(texts, least=least)


def test_top_share_and_longest(documents, texts):
    assert mined(documents, texts, least=3, top=4, share=60, longest=3) == plain(texts, least=3, top=4, share=60, longest=3)


def test_fingerprints_do_not_depend_on_the_place_or_the_block(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.frombuffer((b"the same run of words " + bytes(rng.integers(97, 123, 5000, dtype=np.uint8)) + b" ") * 3, np.uint8)
    words = Words(np.array([0, len(data)]), data)
    whole = words.gram_fingerprints(words.grams(3), 3)
    assert whole[0][0] == whole[0][6] == whole[0][12] and whole[1][0] == whole[1][6] and len(set(whole[0].tolist())) == 6
    monkeypatch.setattr(phrases, "BLOCK", 700)
    again = Words(np.array([0, len(data)]), data).gram_fingerprints(words.grams(3), 3)
    assert all((a == b).all() for a, b in zip(whole, again, strict=True))
    start, end = int(words.starts[2]), int(words.ends[4])
    (base, prime), (base2, prime2), _ = POLYNOMIALS
    letters = [int(x) + 1 for x in words.buffer[start:end]]
    wanted = sum(x * pow(base, k, prime) for k, x in enumerate(letters)) % prime << 31 | sum(x * pow(base2, k, prime2) for k, x in enumerate(letters)) % prime2
    assert whole[0][2] == wanted


def test_empty_tables_and_extra_columns(spark, documents, tables):
    assert mined(documents, []) == [] and mined(documents, [(1, None, None), (2, "", "en")]) == []
    folder = tables(documents=documents([(i, "So it goes, so IT goes", None) for i in range(60)]))
    out = sorted(map(tuple, op13_collocations(spark, folder).collect()))
    assert out == plain([(i, "So it goes, so IT goes", None) for i in range(60)]) and out[0][:4] == ("und", 1, "so it goes", 120)
