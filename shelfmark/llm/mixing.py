"""Mixing to target weights with soft membership: every document belongs to each domain with a probability.

Logistic models are trained on a bounded sample of the labelled table; its quality and toxic flags make the domains good, low and toxic.
Every document gets domain probabilities in thousandths.  Nonnegative rates (expected copies) are then fitted by projected gradient
descent on the squared differences between the domains' expected token totals and their targets.  Steps are scaled by document
length, so a rate depends on the probabilities alone, starting at 1; documents with equal probabilities are summed first, and each
step is one distributed aggregate over these sums.  Then ``settle`` goes on with steps scaled by each domain's own mass, until every
domain is within the tolerance of its own target, however small its share.  A domain with target 0 is done when a document wholly
in it has a rate of at most the tolerance; small memberships of other documents do not push it further.  ``settle`` works on the
driver, on the token sums of the different probabilities: at most 501,501 rows (thousandths of three domains), whatever the table.

Defined results: a null or empty text has no tokens and the probabilities of the bias; without labels each flag has probability one half;
repeated rows get equal probabilities and rates; rows of `labels` with a null are not used; copies are the rate's whole part plus one
with the probability of the rest, drawn by a hash of doc_id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import byte_slices, materialise
from shelfmark.llm.words import word_hashes, word_spans

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.85, "low": 0.15, "toxic": 0.0}
TRAIN_ROWS = 4000
TRAIN_BYTES = 100_000
LEAST_TEXTS = 8
MOST_SHARE = 0.1
TOLERANCE = 0.01
STEPS = 80
SLICE = 2 << 20
TRAIN_SLICE = 1 << 17  # on the driver
DENSE = ("bias", "symbols", "capitals", "repeats", "length")
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[*b"#$%&*!@^~|<>{}[]\\=+_/"]] = True
IS_CAPITAL = np.zeros(256, bool)
IS_CAPITAL[65:91] = True


def features(offsets: np.ndarray, data: np.ndarray):
    """(dense features, distinct word hashes of each text, token counts)."""
    low, starts, ends, firsts = word_spans(offsets, data)
    hashes = word_hashes(low, starts, ends)
    distinct = [np.unique(hashes[a:b]) for a, b in zip(firsts, firsts[1:])]
    tokens = np.diff(firsts)
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask[data])))[offsets]) / np.maximum(np.diff(offsets), 1)
    repeats = 1 - np.array([len(x) for x in distinct]) / np.maximum(tokens, 1)
    dense = np.stack([np.ones(len(tokens)), np.minimum(share(IS_SYMBOL) * 10, 3), np.minimum(share(IS_CAPITAL) * 5, 3), repeats * (tokens > 0) * 3,
                      np.log1p(tokens) / 5], axis=1)
    return dense, distinct, tokens


class FlagModel:
    """Probabilities of the two flags (toxic; low quality) from dense features and from the presence of words.

    The domains follow: toxic; low if not toxic; good if neither.  Few words keep a weight.
    """

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, dense: np.ndarray):
        self.vocabulary, self.words, self.dense = vocabulary, words, dense

    def probabilities(self, dense: np.ndarray, distinct: list[np.ndarray]) -> np.ndarray:
        scores = dense @ self.dense
        if len(self.vocabulary):
            row = np.repeat(np.arange(len(distinct)), [len(x) for x in distinct])
            hashes = np.concatenate(distinct) if distinct else np.zeros(0, np.uint64)
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes
            for k in range(scores.shape[1]):
                scores[:, k] += np.bincount(row[hit], self.words[at[hit], k], len(distinct))
        toxic, low = 1 / (1 + np.exp(-np.clip(scores.T, -30, 30)))
        return np.stack([(1 - toxic) * (1 - low), (1 - toxic) * low, toxic], axis=1)


def _largest_square(row, column, dense, n: int, width: int) -> float:
    """The largest eigenvalue of the mean outer product of the features, by power iteration; it bounds the step."""
    w, d, size = np.full(width, 1.0), np.ones(dense.shape[1]), 1.0
    for _ in range(20):
        y = (np.bincount(row, w[column], n) + dense @ d) / n
        w, d = np.bincount(column, y[row], width), dense.T @ y
        size = float(np.sqrt((w * w).sum() + (d * d).sum()))
        w, d = w / size, d / size
    return 1.1 * size


def train(dense: np.ndarray, distinct: list[np.ndarray], flags: np.ndarray, steps: int = 400, thrift: float = 5e-5) -> FlagModel:
    """Accelerated proximal gradient: cross entropy with an absolute-value penalty on word weights."""
    n, k = flags.shape
    row = np.repeat(np.arange(n), [len(x) for x in distinct])
    words, column, texts = np.unique(np.concatenate(distinct), return_inverse=True, return_counts=True)
    common = (texts >= LEAST_TEXTS) & (texts <= max(LEAST_TEXTS, MOST_SHARE * n))
    place = np.cumsum(common) - 1
    use = common[column]
    row, column, vocabulary = row[use], place[column[use]], words[common]
    weight_w, weight_d = np.zeros((len(vocabulary), k)), np.zeros((dense.shape[1], k))
    look_w, look_d, inertia = weight_w, weight_d, 1.0
    rate = 4.0 / _largest_square(row, column, dense, n, len(vocabulary))
    for _ in range(steps):
        scores = dense @ look_d
        for c in range(k):
            scores[:, c] += np.bincount(row, look_w[column, c], n)
        error = (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - flags) / n
        slope = np.stack([np.bincount(column, error[row, c], len(vocabulary)) for c in range(k)], axis=1)
        new_w = look_w - rate * slope
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * thrift, 0)
        new_d = look_d - rate * (dense.T @ error)
        ahead = (1 + np.sqrt(1 + 4 * inertia**2)) / 2
        look_w = new_w + (inertia - 1) / ahead * (new_w - weight_w)
        look_d = new_d + (inertia - 1) / ahead * (new_d - weight_d)
        weight_w, weight_d, inertia = new_w, new_d, min(ahead, 20.0)
    kept = np.abs(weight_w).max(1) > 1e-6 if len(vocabulary) else np.zeros(0, bool)
    return FlagModel(vocabulary[kept], weight_w[kept], weight_d)


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FlagModel:
    """Trains on about `rows` labelled documents of at most TRAIN_BYTES bytes, chosen by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    flags = [(F.col("toxic") == 1).cast("int").alias("toxic"), (F.col("quality") != 1).cast("int").alias("low")]
    sample = known.where(place < min(1.0, rows / max(total, 1))).select("doc_id", *flags).limit(2 * rows)
    texts = documents.where(F.octet_length("text").between(1, TRAIN_BYTES)).select("doc_id", "text")
    found = texts.join(F.broadcast(sample), "doc_id").limit(4 * rows).toPandas().sort_values(["doc_id", "text", "toxic", "low"])
    if not len(found):
        return FlagModel(np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros((len(DENSE), 2)))
    dense, distinct = [], []
    for _, offsets, data in byte_slices(pa.array([x.encode() for x in found["text"]], pa.binary()), TRAIN_SLICE):
        d, words, _ = features(offsets, data)
        dense.append(d)
        distinct += words
    return train(np.concatenate(dense), distinct, found[["toxic", "low"]].to_numpy(float))


def memberships(documents: DataFrame, model: FlagModel, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, tokens, and p (thousandths of each domain, in sum 1000) for every row."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches):
        for batch in batches:
            tokens, shares = [], []
            for _, offsets, data in byte_slices(batch.column(batch.num_columns - 1), SLICE):
                dense, distinct, counts = features(offsets, data)
                p = model.probabilities(dense, distinct)
                rounded = np.floor(p * 1000).astype(np.int32)
                rounded[np.arange(len(p)), p.argmax(1)] += 1000 - rounded.sum(1)
                tokens.append(counts)
                shares.append(rounded)
            flat = np.concatenate(shares).ravel() if shares else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(DOMAINS)), pa.int32()), pa.array(flat, pa.int32()))
            counted = pa.array(np.concatenate(tokens) if tokens else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counted, lists], names=[*keep, "tokens", "p"])

    rows = documents.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    schema = rows.drop("_bytes").schema.add("tokens", T.LongType()).add("p", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate after all steps: at each, minus the step's product with the probabilities, not below 0."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    change = lambda s: sum(s[k] * p[k] for k in range(len(DOMAINS))) / 1000
    return F.aggregate(moves, F.lit(1.0), lambda rate, s: F.greatest(F.lit(0.0), rate - change(s)))


def _cells(members: DataFrame) -> DataFrame:
    """p, tokens: the tokens of all documents with equal probabilities."""
    return materialise(members.groupBy("p").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")


def fit_rates(members: DataFrame, targets: dict[str, float], tolerance: float = TOLERANCE, limit: int = STEPS) -> list[list[float]]:
    """Steps of projected gradient descent until every domain is within `tolerance` of the total from its target."""
    cells = _cells(members)
    size = len(DOMAINS)
    product = [F.sum(F.col("tokens") * (F.col("p")[i] * F.col("p")[j] / 1e6)) for i in range(size) for j in range(size)]
    first = cells.agg(F.sum("tokens").alias("n"), *[x.alias(f"g{k}") for k, x in enumerate(product)]).first()
    if not first.n:
        return []
    total = float(first.n)
    wanted = np.array([targets[k] for k in DOMAINS]) / max(sum(targets.values()), 1e-12)
    gram = np.array([first[f"g{k}"] for k in range(size * size)], float).reshape(size, size) / total
    length = 1.0 / float(np.linalg.eigvalsh(gram)[-1])
    steps: list[list[float]] = []
    while len(steps) < limit:
        rate = rate_of(F.col("p"), steps)
        sums = cells.select("tokens", "p", rate.alias("rate")).agg(*[F.sum(F.col("tokens") * F.col("rate") * F.col("p")[k] / 1000) for k in range(size)]).first()
        over = np.array([float(x) for x in sums]) / total - wanted
        if np.abs(over).max() <= tolerance:
            break
        steps.append((length * over).tolist())
    return steps


def settle(members: DataFrame, targets: dict[str, float], steps: list[list[float]], tolerance: float = TOLERANCE) -> list[list[float]]:
    """The given steps and more, until every domain is within `tolerance` of its own target, or no step changes a total any more."""
    columns = [F.col("p")[k].alias(f"p{k}") for k in range(len(DOMAINS))]
    cells = _cells(members).select("tokens", *columns).toPandas().sort_values([f"p{k}" for k in range(len(DOMAINS))])
    if not len(cells):
        return steps
    share = cells["tokens"].to_numpy(float) / cells["tokens"].sum()
    p = cells.drop(columns="tokens").to_numpy(float) / 1000
    wanted = np.array([targets[k] for k in DOMAINS]) / max(sum(targets.values()), 1e-12)
    gram = (p * share[:, None]).T @ p
    mass = share @ p
    present, zero = mass > 0, wanted == 0
    scale = np.where(present, 1 / np.where(present, np.diag(gram), 1), 0)
    scale = scale / float(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale))[-1])
    # The last rows are documents wholly in one domain; they have no tokens.
    p, share = np.concatenate((p, np.eye(len(DOMAINS)))), np.concatenate((share, np.zeros(len(DOMAINS))))
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0, rate - p @ step)
    steps, before = list(steps), None
    while True:
        over, pure = (share * rate) @ p - wanted, rate[-len(DOMAINS):]
        off = np.where(zero, pure > tolerance, np.abs(over) > tolerance * wanted)
        moved = np.inf if before is None else (np.abs(over - before)[present] / np.maximum(mass, wanted)[present]).max()
        if not (off & present).any() or moved < 1e-6:
            return steps
        step = scale * over
        step[zero] = np.minimum(step[zero], pure[zero])
        rate, before = np.maximum(0, rate - p @ step), over
        steps.append(step.tolist())


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, tokens, p_good, p_low, p_toxic, rate, copies for every row."""
    keep = ["doc_id"] if keep is None else keep
    members = materialise(memberships(documents, fit(documents, labels), keep), "members")
    targets = targets or TARGETS
    rate = rate_of(F.col("p"), settle(members, targets, fit_rates(members, targets)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    out = members.withColumn("rate", F.round(rate, 6))
    copies = F.floor("rate") + (place < F.col("rate") - F.floor("rate")).cast("long")
    shares = [(F.col("p")[k] / 1000).alias(f"p_{name}") for k, name in enumerate(DOMAINS)]
    return out.select(*keep, "tokens", *shares, "rate", copies.alias("copies"))
