"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

Base spans come from four patterns.  The network is trained on the base spans of a bounded sample; it then reads every whole text
in overlapping windows.  Where windows overlap, a character takes the tag of the window in whose middle it lies further; runs of one
tag over the joined text are spans.  A span is added when it meets no base span and passes the same check of its kind (digits, Luhn
sum, parts), so numbers that two neighbours made unreadable for the patterns are found and failing numbers are not.

Defined results: a null text is empty; an empty text has no spans; repeated rows get equal results; a table without base spans
trains no model and gives base spans only; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.crf import all_outside, best_path, negative_log_likelihood
from shelfmark.llm.recurrent import LSTM, BiRNN

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 3000
PIECE = 96
HIDDEN = 8
STEPS = 160
WINDOW, OVERLAP = 384, 48
SLICE = 1 << 20
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(x * 2 - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def is_ip(found: str) -> bool:
    parts = found.split(".")
    return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in parts)


def is_card(found: str) -> bool:
    digits = NO_DIGIT.sub("", found)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 10 <= len(NO_DIGIT.sub("", found)) <= 15


def emails(text: str):
    """Leftmost matches without overlap, by their @: the local part is the run before it, so no text is scanned again and again."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            start = at
            while start > end and not NOT_LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                end = domain.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for kind, (pattern, good) in enumerate(((IP, is_ip), (CARD, is_card), (PHONE, is_phone)), 1):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if good(m[0])]
    return sorted(out)


def _symbols(codes: np.ndarray) -> np.ndarray:
    """ASCII as it is with one symbol for all digits; every other character is symbol 128."""
    codes = np.minimum(codes, 128).astype(np.uint8)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def training_pieces(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> pd.DataFrame:
    """(piece, tags) of about `sample_docs` documents chosen by a hash: pieces around base spans and at hashed places."""
    total = documents.count()
    if not total:
        return pd.DataFrame({"piece": [], "tags": []})
    place = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 20)) / float(1 << 20)
    sample = documents.where((place < min(1.0, sample_docs / total)) & (F.length("text") > 0)).limit(2 * sample_docs)

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                rng = np.random.default_rng(abs(hash(int(doc_id))) if pd.notna(doc_id) else 0)
                spans = base_spans(text)
                tags = np.zeros(len(text), np.uint8)
                for a, kind, b in spans:
                    tags[a:b] = kind + 1
                near = [spans[k][0] - int(rng.integers(0, PIECE - 30)) for k in rng.permutation(len(spans))[:3]]
                for start in [*near, int(rng.integers(0, max(1, len(text) - PIECE)))]:
                    start = max(0, start)
                    rows.append((doc_id, text[start : start + PIECE].ljust(PIECE), tags[start : start + PIECE].tobytes().ljust(PIECE, b"\0")))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "tags"])

    out = sample.select("doc_id", "text").mapInPandas(run, "doc_id long, piece string, tags binary").toPandas()
    return out.sort_values(["doc_id", "piece"])[["piece", "tags"]]


def fit(sample: pd.DataFrame, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> BiRNN | None:
    """Half of each batch holds spans; a third of those get two spans set side by side, as lists of data have them."""
    if not len(sample):
        return None
    x = np.stack([_symbols(_codes(p)) for p in sample["piece"]])
    y = np.stack([np.frombuffer(t, np.uint8) for t in sample["tags"]])
    full = np.flatnonzero(y.any(1))
    if not len(full):
        return None
    rng = np.random.default_rng(seed)
    spans = []
    for row in full:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], y[row], [0]))))
        spans += [(row, a, b) for a, b in zip(edges, edges[1:]) if y[row, a] and 5 < b - a < 40 and 0 < a and b < PIECE]

    def beside(row: int):
        xs, ys = x[row].copy(), y[row].copy()
        if len(spans) < 2:
            return xs, ys
        parts_x, parts_y = [x[row, :20]], [y[row, :20] * 0]
        for k in rng.integers(0, len(spans), 2):
            r, a, b = spans[k]
            parts_x += [np.array([32], np.uint8), x[r, a:b]]
            parts_y += [np.array([0], np.uint8), y[r, a:b]]
        parts_x.append(np.array([32], np.uint8))
        parts_y.append(np.array([0], np.uint8))
        plain = np.flatnonzero(~y.any(1))
        tail = x[plain[rng.integers(0, len(plain))]] if len(plain) else np.full(PIECE, 32, np.uint8)
        xs = np.concatenate([*parts_x, tail])[:PIECE]
        ys = np.concatenate([*parts_y, tail * 0])[:PIECE]
        xs[:20][y[row, :20] > 0] = 32
        return xs, ys

    def batches():
        for _ in range(steps):
            rows = np.concatenate([full[rng.integers(0, len(full), 32)], rng.integers(0, len(x), 32)])
            picked = [beside(r) if k < 11 else (x[r], y[r]) for k, r in enumerate(rows)]
            yield np.stack([p[0] for p in picked]).T.astype(np.intp), np.stack([p[1] for p in picked]).T.astype(np.intp)

    model = BiRNN(LSTM, 129, hidden, len(KINDS), seed, {"transitions": np.zeros((len(KINDS) + 1,) * 2)})
    model.p["bias"] -= 2
    model.train(batches(), negative_log_likelihood, 0.02)
    return model


def window_tags(model: BiRNN, codes: np.ndarray, offsets: np.ndarray):
    """(positions, tags) of the characters that are tagged, over all texts of a slice joined together.

    Windows of WINDOW characters start every WINDOW - OVERLAP; each answers for its middle, the first and the last for their ends.
    """
    lengths, stride = np.diff(offsets), WINDOW - OVERLAP
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // stride)), 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    inside = nth * stride + np.arange(WINDOW)[:, None]
    length = lengths[owner]
    place = offsets[owner] + np.minimum(inside, length - 1)
    symbols = codes[place]
    symbols[inside >= length] = 32
    scores = model.scores(symbols)
    moves = model.p["transitions"]
    open_rows = np.flatnonzero(~all_outside(scores, moves.copy()))
    tags = best_path(scores[:, open_rows], moves)
    at = np.arange(WINDOW)[:, None]
    own = (at >= np.where(nth[open_rows] == 0, 0, OVERLAP // 2)) & (at < np.where(nth[open_rows] == count[owner[open_rows]] - 1, WINDOW, WINDOW - OVERLAP // 2))
    keep = own & (tags > 0) & (inside[:, open_rows] < length[open_rows])
    order = np.argsort(place[:, open_rows][keep], kind="stable")
    return place[:, open_rows][keep][order], tags[keep][order]


SHAPES = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), IP, CARD, re.compile(r"\+?[0-9(][\x20().0-9-]+[0-9]"))
CHECKS = (lambda _: True, is_ip, is_card, is_phone)
EDGES = (".,;:!?()[]<>\"' ", ".,;:()- ", ".,;:()- ", ".,;:)- ")


def added_spans(text: str, positions: np.ndarray, tags: np.ndarray, base: list) -> list[tuple[int, int, int]]:
    """Runs of one tag, trimmed; kept if they have the shape of their kind, pass its check, stand alone and meet no base span."""
    out = []
    cuts = np.flatnonzero((np.diff(positions) != 1) | (np.diff(tags) != 0)) + 1
    for run_at, run_tags in zip(np.split(positions, cuts), np.split(tags, cuts), strict=True):
        kind, a, b = int(run_tags[0]) - 1, int(run_at[0]), int(run_at[-1]) + 1
        found = text[a:b]
        a += len(found) - len(found.lstrip(EDGES[kind]))
        b -= len(found) - len(found.rstrip(EDGES[kind]))
        alone = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
        if a < b and alone and SHAPES[kind].fullmatch(text, a, b) and CHECKS[kind](text[a:b]) and not any(s < b and a < e for s, _, e in base):
            out.append((a, kind, b))
    return out


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def find_personal_data(documents: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """One row a document: base counts and digest, all spans, and how many the network added."""
    model = fit(training_pieces(documents if training is None else training))
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def describe(texts: list[str]):
        base = [base_spans(x) for x in texts]
        added: list[list] = [[] for _ in texts]
        offsets = np.cumsum([0, *map(len, texts)])
        if model is not None and offsets[-1]:
            positions, tags = window_tags(model, _symbols(_codes("".join(texts))), offsets)
            cuts = np.searchsorted(positions, offsets)
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                added[k] = added_spans(texts[k], positions[part] - offsets[k], tags[part], base[k])
        for own, more in zip(base, added, strict=True):
            kinds = [k for _, k, _ in own]
            yield (*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(as_text(own).encode()).hexdigest(), as_text(own + more), len(more))

    def run(batches):
        for batch in batches:
            texts, rows, first = [x or "" for x in batch.column(1).to_pylist()], [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE):
                    size += len(texts[last])
                    last += 1
                rows += describe(texts[first:last])
                first = last
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
