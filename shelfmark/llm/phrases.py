"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks and into words at blanks.  In numpy, prefix polynomials over
the bytes of a whole batch give the fingerprint of every n-gram by two differences: two residues modulo primes below 2**31, 62 bits.
Only fingerprints are shuffled, added up within each batch and task first.  Lengths go one after the other: an n-gram can only be
frequent if both of its shorter ends are, and a Bloom filter of fixed size leaves out most others before the shuffle.  A row of these
passes is a key and a count.  One more pass takes what can be frequent of every length: an aggregate by language and fingerprint holds
the count, a pointer to one occurrence (the smallest text hash, with the place in that text) and the range of a check, a third polynomial
modulo 2**64.

Then the pointers of frequent fingerprints are joined with their texts and only these phrases are materialised.  The text is hashed
again: a phrase that does not have the fingerprint and the check (two texts of equal hash), or a fingerprint with more than one check
(two phrases of equal fingerprint), is a collision, and its occurrences are counted once more by the text itself.

Scores are whole numbers in decimals of 38 digits.

Defined results: a null text is empty, a null language is `und` (and counts together with rows that say so).  Words of any length and
bytes are words; equal rows count each.  No rows, or none frequent, give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bit_test, byte_slices, is_empty, materialise
from shelfmark.llm.words import mix

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
POLYNOMIALS = ((1103515245, 2147483647), (1566083941, 2147483629), (0xD1342543DE82EF95, None))  # base, modulus (None: 2**64)
LOG2_BITS = 25
MASK = np.uint64((1 << LOG2_BITS) - 1)
BLOCK = 1 << 22  # 2**8 (letters) * 2**31 (residues) * 2**22 stays below 2**64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, CUT = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_TABLES: dict[tuple, np.ndarray] = {}


def _powers(base: int, prime: int | None, count: int) -> np.ndarray:
    """base**k for k < count: modulo a prime by doubling, or modulo 2**64."""
    kept = _TABLES.get((base, prime))
    if kept is None or len(kept) < count:
        kept, size = np.ones(1, np.uint64), max(count, 1 << 16)
        while len(kept) < size:
            if prime is None:
                kept = np.concatenate((kept, kept * np.uint64(pow(base, len(kept), 1 << 64))))
            else:
                kept = np.concatenate((kept, kept * np.uint64(pow(base, len(kept), prime)) % np.uint64(prime)))
        _TABLES[base, prime] = kept
    return kept[:count]


def _prefix_sums(letters: np.ndarray, powers: np.ndarray, prime: int | None) -> np.ndarray:
    """Prefix polynomial of a buffer.  Sums of a block stay below 2**64, so only their carry is reduced."""
    out = np.zeros(len(letters) + 1, np.uint64)
    for start in range(0, len(letters), BLOCK):
        end = min(start + BLOCK, len(letters))
        np.cumsum(letters[start:end] * powers[start:end], out=out[start + 1 : end + 1])
        carry = out[start] if prime is None else out[start] % np.uint64(prime)
        out[start + 1 : end + 1] += carry
    return out


GRAMS = pa.schema([("lang", pa.string()), ("n", pa.int32()), *((name, pa.int64()) for name in ("fp", "a", "check", "th", "span"))])
RECOUNTED = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("fp", pa.int64()), ("phrase", pa.string()), ("a", pa.int64())])


class Words:
    """The words of a batch of texts in one normalised buffer: every word is followed by one blank.

    starts, ends: places in the buffer; piece: number of the piece a word lies in; text: row of the text; base: buffer place where
    each text begins.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        low = LOWER[data]
        inside = ~(BLANK[low] | CUT[low])
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
        first, last = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        cuts = np.concatenate(([0], np.cumsum(CUT[low])))
        self.text = np.searchsorted(offsets, first, side="right") - 1
        self.piece = cuts[first] + self.text
        sizes = last - first
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.buffer = np.full(int(self.ends[-1]) + 1 if len(first) else 0, 0x20, np.uint8)
        inner = np.ones(len(self.buffer), bool)
        inner[self.ends] = False
        self.buffer[inner] = low[inside]
        self.base = np.concatenate(([0], np.cumsum(np.bincount(self.text, weights=sizes + 1, minlength=len(offsets) - 1)))).astype(np.int64)
        self._sums = None

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie within one piece."""
        count = len(self) - n + 1
        return np.flatnonzero(self.piece[: max(count, 0)] == self.piece[n - 1 :]) if count > 0 else np.zeros(0, np.int64)

    def fingerprints(self, starts: np.ndarray, ends: np.ndarray, bits: int = 62) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, check) of the stretches from `starts` to `ends` in the buffer."""
        size = len(self.buffer)
        if self._sums is None:
            letters = self.buffer.astype(np.uint64) + np.uint64(1)
            self._sums = [_prefix_sums(letters, _powers(base, prime, size), prime) for base, prime in POLYNOMIALS]
        parts = []
        for sums, (base, prime) in zip(self._sums, POLYNOMIALS, strict=True):
            back = _powers(pow(base, -1, prime or 1 << 64), prime, size)[starts]
            if prime is None:
                parts.append(mix((sums[ends] - sums[starts]) * back))
            else:
                p = np.uint64(prime)
                parts.append((sums[ends] % p + p - sums[starts] % p) % p * back % p)
        return ((parts[0] << np.uint64(31) | parts[1]) & np.uint64((1 << bits) - 1)).view(np.int64), parts[2].view(np.int64)

    def gram_fingerprints(self, first: np.ndarray, n: int, bits: int = 62) -> tuple[np.ndarray, np.ndarray]:
        return self.fingerprints(self.starts[first], self.ends[first + n - 1], bits)

    def phrase(self, start: int, end: int) -> str:
        return bytes(self.buffer[start:end]).decode("utf-8", "replace")


def _batches(batches, text: int):
    """(batch, first row, words) of every slice of the text column."""
    for batch in batches:
        for first, offsets, data in byte_slices(batch.column(text)):
            words = Words(offsets, data)
            if len(words):
                yield batch, first, words


def _keys(fingerprints: np.ndarray, language: np.ndarray) -> np.ndarray:
    """One hash of a fingerprint and a language; equal hashes of different ones only let more through the filters."""
    return mix(fingerprints.view(np.uint64) ^ language)


def _language_hash(names: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(name.encode()) + (len(name) << 32) for name in names], np.uint64))


def _languages(batch, first: int, count: int) -> tuple[list[str], np.ndarray]:
    """(names, which of them each text of a slice has)."""
    coded = batch.column(0).slice(first, count).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _bits(keys: DataFrame) -> np.ndarray:
    """Bloom filter of a column `key`: 2**LOG2_BITS bits, merged by an aggregate of at most 2**(LOG2_BITS - 6) words."""
    slot = F.col("key").bitwiseAND(F.lit((1 << LOG2_BITS) - 1))
    words = keys.select(F.shiftright(slot, 6).alias("w"), F.expr("1L").alias("one"), F.pmod(slot, F.lit(64)).cast("int").alias("s"))
    merged = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, s)")).alias("v")).toArrow()
    out = np.zeros(1 << (LOG2_BITS - 6), np.int64)
    out[merged.column("w").to_numpy()] = merged.column("v").to_numpy()
    return out.view(np.uint64)


def _passing(words: Words, language: np.ndarray, first: np.ndarray, n: int, known: np.ndarray, bits: int) -> np.ndarray:
    """Which of the n-grams at `first` a filter lets through."""
    keys = _keys(words.gram_fingerprints(first, n, bits)[0], language[words.text[first]])
    return bit_test(known, keys & MASK)


def gram_keys(texts: DataFrame, n: int, shorter: np.ndarray | None, least: int, bits: int) -> DataFrame:
    """key, a: hashes of (language, fingerprint of an n-gram) that occur `least` times or more.

    texts: lang, th (text hash), t (bytes).  `shorter` filters by the keys of length n - 1.
    """
    sent = texts.sparkSession.sparkContext.broadcast(shorter)

    def run(batches):
        known = sent.value
        for batch, row, words in _batches(batches, 2):
            names, which = _languages(batch, row, len(words.base) - 1)
            language = _language_hash(names)[which]
            first = words.grams(n)
            if known is not None:
                first = first[_passing(words, language, first, n - 1, known, bits)]
                first = first[_passing(words, language, first + 1, n - 1, known, bits)]
            if len(first):
                keys = _keys(words.gram_fingerprints(first, n, bits)[0], language[words.text[first]])
                key, a = np.unique(keys.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a)], ["key", "a"])

    return texts.mapInArrow(run, "key long, a long").groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def pointed(texts: DataFrame, filters: dict[int, np.ndarray], least: int, bits: int) -> DataFrame:
    """lang, n, fp, a, low, high (range of checks), th, span of the fingerprints that pass the filters of their length, a >= least.

    n = 0: the number of all words of the language.
    """
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch, row, words in _batches(batches, 2):
            count = len(words.base) - 1
            names, which = _languages(batch, row, count)
            language = _language_hash(names)
            hashes, rank = np.unique(batch.column(1).slice(row, count).to_numpy(), return_inverse=True)
            totals = np.bincount(which[words.text], minlength=len(names))
            zeros = [0] * len(names)
            yield pa.RecordBatch.from_pydict({"lang": names, "n": zeros, "fp": zeros, "a": totals, "check": zeros, "th": zeros, "span": zeros}, GRAMS)
            for n, known in sent.value.items():
                first = words.grams(n)
                first = first[_passing(words, language[which], first, n, known, bits)]
                if not len(first):
                    continue
                fp, check = words.gram_fingerprints(first, n, bits)
                text = words.text[first]
                key = _keys(fp, language[which[text]])
                order = np.argsort(key, kind="stable")
                key, fp, check, text, first = key[order], fp[order], check[order], text[order], first[order]
                new = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]) | (check[1:] != check[:-1]) | (which[text[1:]] != which[text[:-1]])
                starts = np.flatnonzero(np.concatenate(([True], new)))
                sizes = np.diff(np.append(starts, len(key)))
                shown = np.minimum.reduceat(rank[text].astype(np.int64) << 32 | np.arange(len(key)), starts) & ((1 << 32) - 1)
                start, end = words.starts[first[shown]], words.ends[first[shown] + n - 1]
                begin = words.base[text[shown]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.string()).take(pa.array(which[text[shown]])), pa.array([n] * len(shown), pa.int32()), pa.array(fp[shown]),
                    pa.array(sizes), pa.array(check[shown]), pa.array(hashes[rank[text[shown]]]), pa.array((start - begin) << 31 | (end - start)),
                ], schema=GRAMS)

    found = texts.mapInArrow(run, "lang string, n int, fp long, a long, check long, th long, span long").groupBy("lang", "n", "fp").agg(
        F.sum("a").alias("a"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("th").alias("th"), F.min_by("span", "th").alias("span"))
    return found.where((F.col("a") >= least) | (F.col("n") == 0))


def materialised(texts: DataFrame, grams: DataFrame, bits: int) -> DataFrame:
    """lang, n, fp, a, phrase, same: the phrase that each pointer shows, and whether its text has the fingerprint and the check.

    Pointers are to the smallest text hashes, so only few texts pass the filter and travel.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_bits(grams.select(F.col("th").alias("key"))))

    def few(batches):
        for batch in batches:
            yield batch.filter(pa.array(bit_test(sent.value, batch.column(0).to_numpy().view(np.uint64) & MASK)))

    shown = texts.select("th", "t").mapInArrow(few, "th long, t binary").dropDuplicates(["th"])
    pointers = grams.groupBy("th").agg(F.collect_list(F.struct("lang", "n", "fp", "a", "low", "high", "span")).alias("pointers"))

    def cut(batches):
        for batch in batches:
            for row, (_, offsets, data) in enumerate(byte_slices(batch.column(0), 1)):
                words, pointers = Words(offsets, data), batch.column(1)[row].values.flatten()
                lang, n, fp, a, low, high, span = pointers
                start, size = span.to_numpy() >> 31, span.to_numpy() & ((1 << 31) - 1)
                inside = start + size <= len(words.buffer)
                start, size = np.where(inside, start, 0), np.where(inside, size, 0)
                if len(words):
                    now, check = words.fingerprints(start, start + size, bits)
                else:
                    now, check = fp.to_numpy() * 0, fp.to_numpy() * 0
                same = inside & (now == fp.to_numpy()) & (check == low.to_numpy()) & (low.to_numpy() == high.to_numpy())
                phrases = [words.phrase(x, x + y) if ok else None for x, y, ok in zip(start.tolist(), size.tolist(), same.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([lang, n, fp, a, pa.array(phrases, pa.string()), pa.array(same)], ["lang", "n", "fp", "a", "phrase", "same"])

    # Single rows: byte_slices with a limit of one byte gives one text a slice unless it is empty, and no pointer shows an empty text.
    joined = shown.join(pointers, "th").where(F.length("t") > 0).select("t", "pointers")
    return joined.mapInArrow(cut, "lang string, n int, fp long, a long, phrase string, same boolean")


def _keyed(grams: DataFrame) -> DataFrame:
    """n and key of rows (lang, n, fp)."""

    def run(batches):
        for batch in batches:
            names, which = _languages(batch, 0, len(batch))
            keys = _keys(batch.column(2).to_numpy(), _language_hash(names)[which])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys.view(np.int64))], ["n", "key"])

    return grams.select("lang", "n", "fp").mapInArrow(run, "n int, key long")


def recounted(texts: DataFrame, collided: DataFrame, longest: int, bits: int) -> DataFrame:
    """lang, n, phrase, a of all n-grams whose fingerprint is among `collided` (lang, n, fp), counted by the text itself."""
    found = materialise(_keyed(collided), "collided-keys")
    filters = {n: _bits(found.where(F.col("n") == n)) for n in range(1, longest + 1)}
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch, row, words in _batches(batches, 2):
            names, which = _languages(batch, row, len(words.base) - 1)
            language, counts = _language_hash(names), Counter()
            for n, known in sent.value.items():
                first = words.grams(n)
                first = first[_passing(words, language[which], first, n, known, bits)]
                for at, f in zip(first.tolist(), words.gram_fingerprints(first, n, bits)[0].tolist(), strict=True):
                    counts[names[which[words.text[at]]], n, f, words.phrase(words.starts[at], words.ends[at + n - 1])] += 1
            if counts:
                columns = [*zip(*counts, strict=True), tuple(counts.values())]
                yield pa.RecordBatch.from_pydict(dict(zip(("lang", "n", "fp", "phrase", "a"), columns, strict=True)), RECOUNTED)

    found = texts.mapInArrow(run, "lang string, n int, fp long, phrase string, a long").groupBy("lang", "n", "fp", "phrase").agg(F.sum("a").alias("a"))
    return found.join(collided, ["lang", "n", "fp"], "left_semi")


def frequent_phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = 62) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, a of all phrases of up to `longest` words with a >= least; lang, n of all words)."""
    language = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = documents.select(language.alias("lang"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    filters: dict[int, np.ndarray] = {}
    for n in range(1, longest + 1):
        filters[n] = _bits(materialise(gram_keys(texts, n, filters.get(n - 1), least, bits), f"keys-{n}"))
        if not filters[n].any():
            break
    level = materialise(pointed(texts, filters, least, bits), "grams")
    totals, grams = level.where("n = 0").select("lang", F.col("a").alias("n")), level.where("n > 0")
    shown = materialise(materialised(texts, grams, bits), "phrases")
    good = shown.where("same").select("lang", "n", "phrase", "a")
    collided = materialise(grams.join(shown.where("same"), ["lang", "n", "fp"], "left_anti").select("lang", "n", "fp"), "collided")
    if not is_empty(collided):
        good = good.unionByName(recounted(texts, collided, longest, bits).where(F.col("a") >= least).select("lang", "n", "phrase", "a"))
    return materialise(good, "frequent"), totals


def _piece(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, bits: int = 62) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of two words or more in each language.

    A candidate goes if it lies within a longer one with at least `share` percent of its count.
    """
    frequent, totals = frequent_phrases(documents, longest, least, bits)
    candidates = frequent.where("n > 1").withColumnRenamed("n", "size").withColumn("words", F.split("phrase", " "))
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))))
    inside = candidates.where("size > 2").select("lang", span.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))
    cut = left.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _piece(F.lit(1), F.col("k")).alias("first"), _piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    counted = (
        cut.join(parts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
        .join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", F.expr("(1000 * cast(a AS decimal(19, 0)) * n) div (cast(l AS decimal(19, 0)) * r)"))
    )
    lowest = counted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
