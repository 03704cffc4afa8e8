"""Path expressions.  A path is a hierarchy: both ``/`` and ``\\`` separate components, on every platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab as V

EXT_PATTERN = r"(?s)^\.*[^.].*(\.[^.]*)$"
NO_STRINGS = "array<string>"


def components(path: Column) -> Column:
    return F.filter(F.split(path, r"[\\/]+"), lambda part: part != "")


def directories(parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def extension(base: Column) -> Column:
    """Last dot and what follows; leading dots do not start an extension.  Case is kept."""
    return F.regexp_extract(base, EXT_PATTERN, 1)


def stem_of(base: Column) -> Column:
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(base)))


def with_parts(inventory: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``dirs`` (array), ``dir`` (same, joined by ``/``), ``base``, ``stem`` and lower-case ``ext``.

    ``dir`` and ``ext`` are join keys, so they are declared never null: the planner then has no null filter to push below this
    projection, which would split every path twice.
    """
    return (
        inventory.withColumn("_parts", components(F.col(path)))
        .withColumn("dirs", directories(F.col("_parts")))
        .withColumn("base", F.coalesce(F.try_element_at("_parts", F.lit(-1)), F.lit("")))
        .drop("_parts")
        .withColumn("dir", F.coalesce(F.array_join("dirs", "/"), F.lit("")))
        .withColumn("stem", stem_of(F.col("base")))
        .withColumn("ext", F.coalesce(F.lower(extension(F.col("base"))), F.lit("")))
    )


def dirs_of(joined: Column) -> Column:
    """Back from the joined form of ``with_parts`` to the array."""
    return F.when(joined == "", F.array().cast(NO_STRINGS)).otherwise(F.split(joined, "/"))


def ancestors(dirs: Column) -> Column:
    """One struct per ancestor folder, from the top one down to the folder itself."""
    return F.transform(
        dirs, lambda _, i: F.struct(F.array_join(F.slice(dirs, F.lit(1), i + 1), "/").alias("folder"), (i + 1).alias("depth"))
    )


def folder_key(dirs: Column, depth: int = 2) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.slice(dirs, 1, depth), "\\"), F.lit("")), F.lit("."))


def relative_parent(dirs: Column) -> Column:
    return F.when(F.size(dirs) == 0, ".").otherwise(F.array_join(dirs, "/"))


def junk_tier(base: Column) -> Column:
    name = F.lower(base)
    ext = extension(name)
    safe = name.isin(V.SAFE_NAMES) | name.startswith("~$") | ext.isin(V.SAFE_EXT)
    return F.when(safe, "safe").when(ext.isin(V.REVIEW_EXT), "review")


def is_managed(folder: Column) -> Column:
    return folder.isin(V.MANAGED_DIRS) | folder.rlike(V.MANAGED_PATTERN)


def bundle_root_depth(dirs: Column) -> Column:
    """How many leading folders form a software or environment unit; 0 for none."""
    low = F.transform(dirs, F.lower)
    libs = F.filter(F.transform(low, lambda d, i: F.when(d.isin(V.LIB_DIRS), i)), lambda i: i.isNotNull())

    def package_root(at: Column) -> Column:
        lib = F.array_max(F.filter(libs, lambda i: i < at))
        holder = F.when(F.get(low, lib - 1).isin(V.ENV_DIRS), lib - 1).otherwise(lib)
        return F.coalesce(holder, at)

    roots = F.transform(
        low, lambda d, i: F.when(d.isin(V.PROJECT_MARKERS), i).when(d == V.PACKAGE_MARKER, package_root(i))
    )
    marked = F.arrays_overlap(low, F.array(*[F.lit(m) for m in V.PROJECT_MARKERS + [V.PACKAGE_MARKER]]))
    return F.when(marked, F.coalesce(F.array_min(F.filter(roots, lambda i: i > 0)), F.lit(0))).otherwise(F.lit(0))


def has_information(dirs: Column, stem: Column) -> Column:
    """True when some word of three or more letters in the folders or the name is not a generic one."""
    words = F.regexp_extract_all(F.lower(F.concat_ws("/", F.array_join(dirs, "/"), stem)), F.lit("[a-z]{3,}"), 0)
    return F.exists(words, lambda w: ~w.isin(V.GENERIC_WORDS))


def file_kind(ext: Column) -> Column:
    """One of twelve kinds for a lower-case extension without its dot."""
    kind = F.lit(None).cast("string")
    for name, exts in reversed(V.FILE_KINDS.items()):
        kind = F.when(ext.isin(exts.split()), name).otherwise(kind)
    return kind


def plan_text(dirs: Column, stem: Column, ext: Column, types: str | None = "ext") -> Column:
    """What a classifier reads: name, folders, and (by ``types``) the extension word or extension and kind."""
    text = F.translate(F.concat(stem, F.lit(" "), F.array_join(dirs, " ")), "_-", "  ")
    if types is None:
        return text
    word = F.regexp_replace(ext, r"^\.+", "")
    if types == "kind":
        word = F.concat_ws(" ", word, file_kind(word))
    return F.when(F.length(word) > 0, F.concat(text, F.lit(" "), word)).otherwise(text)


def sanitise_topic(topic: Column) -> Column:
    """Letters and digits kept, everything else one underscore, each run of letters in title case."""
    clean = F.regexp_replace(F.regexp_replace(topic, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    runs = F.regexp_extract_all(clean, F.lit(r"\p{L}+|\P{L}+"), 0)
    titled = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r)))))
    return F.array_join(titled, "")
