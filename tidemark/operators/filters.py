"""Item filters: patterns, keys, delta halves, paths, meta items, commits."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.algebra import delta_key
from tidemark.operators.schemas import FORBIDDEN_CHARACTERS

PARTS = ("feature", "meta", "tile")


def parse_pattern(pattern: str) -> tuple[str, str | None, str | None]:
    """``ds``, ``ds:key``, ``ds:feature:key``, ``ds:meta:item`` or ``ds:tile:name``.

    What follows the dataset is a key, unless it begins with the name of a part.
    """
    dataset, _, rest = pattern.partition(":")
    part, _, key = rest.partition(":")
    if part not in PARTS:
        part, key = ("feature", rest) if rest else (None, "")
    steps = dataset.split("/")
    if any(not s or s.startswith(".") or s.endswith(".") for s in steps) or re.search(FORBIDDEN_CHARACTERS, dataset.replace("*", "")):
        raise ValueError(f"not an item pattern: {pattern!r}")
    return dataset, part, key or None


def dataset_matches(dataset: Column, glob: str) -> Column:
    """``*`` stands for any text; every other character for itself."""
    if "*" not in glob:
        return dataset == glob
    expression = ".*".join(re.escape(piece) for piece in glob.split("*"))
    return dataset.rlike(f"(?s)^{expression}$")


def matches_patterns(patterns: Sequence[str], dataset: Column, part: Column, *keys: Column) -> Column:
    """True for items any pattern names; no patterns means everything.

    ``keys`` are the texts of the item's keys (old and new for a delta): one match is enough.
    Keys given for the same dataset and part become one ``IN`` set, so long lists of
    keys stay one hashed lookup per row.
    """
    if not patterns:
        return F.lit(True)
    wanted: dict[tuple[str, str | None], set[str] | None] = {}
    for p in patterns:
        ds, pt, rest = parse_pattern(p)
        slot = (ds, pt)
        if rest is None:
            wanted[slot] = None
        elif wanted.get(slot, set()) is not None:
            wanted.setdefault(slot, set()).add(rest)
    conditions = []
    for (ds, pt), names in wanted.items():
        c = dataset_matches(dataset, ds)
        if pt is not None:
            c = c & (part == pt)
        if names is not None:
            hits = [F.coalesce(k.isin(sorted(names)), F.lit(False)) for k in keys]
            c = c & reduce(lambda x, y: x | y, hits)
        conditions.append(c)
    return reduce(lambda x, y: x | y, conditions)


def exclude_datasets(df: DataFrame, datasets: Sequence[str], column: str = "dataset") -> DataFrame:
    return df.filter(~F.col(column).isin(list(datasets)))


def deltas_at(delta: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Deltas whose old or new key is listed.

    A disjunction of two equi-joins would be a nested loop; two semi joins on
    disjoint parts of the diff are not.
    """
    wanted = keys.select(F.col(key).alias("_k")).distinct()
    by_old = delta.join(wanted, F.col("old_key") == F.col("_k"), "left_semi")
    rest = delta.filter(F.col("new_key").isNotNull()).join(wanted, F.col("new_key") == F.col("_k"), "left_semi")
    moved = rest.filter(F.col("old_key").isNull() | (F.col("old_key") != F.col("new_key")))
    not_twice = moved.join(wanted, F.col("old_key") == F.col("_k"), "left_anti")
    return by_old.unionByName(not_twice)


def coerce_key(text: Column, kind: str) -> Column:
    """Key text as the key column's type, NULL when it is not one."""
    return text.try_cast(kind)


def lookup(df: DataFrame, keys: DataFrame, pk: str, ignore_missing: bool = True) -> DataFrame:
    """Rows of the listed keys; with ``ignore_missing=False`` a missing key fails the job."""
    wanted = keys.select(F.col(pk)).distinct()
    if ignore_missing:
        return df.join(wanted, pk, "left_semi")
    found = wanted.join(df.withColumn("_found", F.lit(True)), pk, "left")
    guarded = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no row with key "), F.col(pk).cast("string"))))
    return found.withColumn("_found", guarded.cast("string")).filter(F.col("_found").isNull()).select(*df.columns)


def missing_keys(df: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    return keys.select(pk).distinct().join(df.select(pk), pk, "left_anti")


def path_selected(path: Column, prefixes: Sequence[str]) -> Column:
    """True when the path itself or a folder above it is selected."""
    hits = [(path == p) | path.startswith(p.rstrip("/") + "/") for p in prefixes]
    return reduce(lambda x, y: x | y, hits) if hits else F.lit(True)


def meta_selected(name: Column, wanted: Sequence[str] | None) -> Column:
    return F.lit(True) if wanted is None else name.isin(list(wanted))


def supported_meta(meta: DataFrame, capable: DataFrame, name: str = "item") -> DataFrame:
    """Meta items the target can store, built-in reference systems left out."""
    kept = meta.join(capable.select(name).distinct(), name, "left_semi")
    crs = meta.filter(F.col(name).startswith("crs/") & ~F.col("builtin"))
    return kept.filter(~F.col(name).startswith("crs/")).unionByName(crs)


def filter_commits(
    commits: DataFrame,
    *,
    since=None,
    until=None,
    author: str | None = None,
    committer: str | None = None,
    message: str | None = None,
) -> DataFrame:
    """Time range and case-sensitive patterns; each given condition must hold."""
    out = commits
    if since is not None:
        out = out.filter(F.col("commit_time") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.filter(F.col("commit_time") <= F.lit(until).cast("timestamp_ntz"))
    for column, pattern in (("author", author), ("committer", committer), ("message", message)):
        if pattern is not None:
            out = out.filter(F.col(column).rlike(pattern))
    return out


def key_in_filter(keys: Sequence[str]) -> Column:
    return delta_key().cast("string").isin([str(k) for k in keys])
