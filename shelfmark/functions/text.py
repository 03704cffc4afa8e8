"""Token and phrase expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import vocab as V


@dataclass(frozen=True)
class NoiseTerms:
    """The four noise lists.  User lists are added to the defaults, in lower case."""

    stopword: list[str] = field(default_factory=lambda: list(V.NOISE_STOPWORDS))
    path_scaffolding: list[str] = field(default_factory=lambda: list(V.NOISE_SCAFFOLDING))
    packaging: list[str] = field(default_factory=lambda: list(V.NOISE_PACKAGING))
    format: list[str] = field(default_factory=lambda: list(V.NOISE_FORMAT))

    def merged(self, **extra: list[str]) -> NoiseTerms:
        union = {k: sorted({*getattr(self, k), *(str(w).lower() for w in words)}) for k, words in extra.items()}
        return replace(self, **union)

    def labels(self) -> dict[str, list[str]]:
        return {k: getattr(self, k) for k in V.NOISE_FACTORS}


# White space inside a text as SQL's ``\s`` has it (no vertical tab), and at its ends every space character of Unicode.
SPACES = r"[\t\n\f\r _-]+"
EDGES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), F.lit(EDGES))


def tokenise(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0)


def noise_labels(token: Column, noise: NoiseTerms) -> Column:
    """Every label a token carries, in alphabetic order."""
    named = F.array(*[F.when(token.isin(words), label) for label, words in sorted(noise.labels().items())])
    return F.filter(named, lambda label: label.isNotNull())


def noise_factor(token: Column, noise: NoiseTerms) -> Column:
    factor = F.lit(1.0)
    for label, words in noise.labels().items():
        factor = factor * F.when(token.isin(words), V.NOISE_FACTORS[label]).otherwise(1.0)
    return factor


def cluster_root(dirs: Column, noise: NoiseTerms, max_parts: int = 3) -> Column:
    def meaning(folder: Column) -> Column:
        kept = F.filter(tokenise(folder), lambda t: ~t.isin(noise.path_scaffolding))
        return F.array_join(F.slice(kept, 1, 2), "_")

    named = F.filter(F.transform(dirs, meaning), lambda m: m != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(named, 1, max_parts), " > "), F.lit("")), F.lit("root"))


def phrases(tokens: Column, min_size: int = 2, max_size: int = 3) -> Column:
    """All runs of ``min_size`` to ``max_size`` tokens that are not one word repeated."""

    def runs(size: int) -> Column:
        grams = F.transform(tokens, lambda _, i: F.slice(tokens, i + 1, size))
        kept = F.filter(grams, lambda g: (F.size(g) == size) & (F.size(F.array_distinct(g)) > 1))
        return F.transform(kept, lambda g: F.array_join(g, " "))

    return F.flatten(F.array(*[runs(size) for size in range(min_size, max_size + 1)]))


def occurrences(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))
