"""Three-way merge of keyed relations: classes, conflicts, resolution, result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diffing import key_of
from tidemark.operators.numbering import number_all

VERSIONS = ("ancestor", "ours", "theirs")


def three_way(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, pk: Sequence[str]) -> DataFrame:
    """``key`` with the row of each version as a struct, NULL where it is absent.

    The three versions are stacked and gathered by key in one shuffle: a key holds at most
    one row of each, so groups have at most three rows, and no side is shuffled twice as
    in a chain of outer joins. Aggregation is by ``first`` of the only non-NULL struct.
    """
    sides = []
    for name, df in zip(VERSIONS, (ancestor, ours, theirs)):
        row = F.struct(*df.columns)
        sides.append(df.select(key_of(pk).alias("key"), row.alias("_row"), F.lit(name).alias("_v")))
    kinds = {str(s.schema["_row"].dataType.simpleString()) for s in sides}
    if len(kinds) > 1:
        return _three_way_joined(ancestor, ours, theirs, pk)
    stacked = reduce(DataFrame.unionByName, sides)
    return stacked.groupBy("key").agg(
        *[F.first(F.when(F.col("_v") == v, F.col("_row")), ignorenulls=True).alias(v) for v in VERSIONS]
    )


def _three_way_joined(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, pk: Sequence[str]) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key_of(pk).alias(f"_k_{name}"), F.struct(*df.columns).alias(name))

    a, o, t = (side(d, n) for d, n in zip((ancestor, ours, theirs), VERSIONS))
    ao = a.join(o, F.col("_k_ancestor") == F.col("_k_ours"), "full_outer").withColumn(
        "_k", F.coalesce("_k_ancestor", "_k_ours")
    )
    all3 = ao.join(t, F.col("_k") == F.col("_k_theirs"), "full_outer")
    return all3.select(F.coalesce("_k", "_k_theirs").alias("key"), *VERSIONS)


def outcome(a: Column, o: Column, t: Column) -> Column:
    """Class of a key: which side changed it, or how the two changes clash."""
    both_same = o.eqNullSafe(t)
    ours_same, theirs_same = o.eqNullSafe(a), t.eqNullSafe(a)
    return (
        F.when(ours_same & theirs_same, "unchanged")
        .when(both_same, "same_change")
        .when(theirs_same, "ours")
        .when(ours_same, "theirs")
        .when(a.isNull(), "conflict_insert_insert")
        .when(o.isNull() | t.isNull(), "conflict_edit_delete")
        .otherwise("conflict_edit_edit")
    )


def merge(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, pk: Sequence[str]) -> DataFrame:
    """:func:`three_way` with an ``outcome`` per key."""
    rows = three_way(ancestor, ours, theirs, pk)
    return rows.withColumn("outcome", outcome(F.col("ancestor"), F.col("ours"), F.col("theirs")))


def is_conflict() -> Column:
    return F.col("outcome").startswith("conflict")


def conflicts(merged: DataFrame) -> DataFrame:
    return merged.filter(is_conflict())


def clean_rows(merged: DataFrame) -> DataFrame:
    """Rows of the keys that merged by themselves."""
    taken = F.when(F.col("outcome") == "theirs", F.col("theirs")).otherwise(F.col("ours"))
    return merged.filter(~is_conflict()).select(taken.alias("_r")).filter(F.col("_r").isNotNull()).select("_r.*")


def label(dataset: str, part: str = "feature", key: str = "key") -> Column:
    return F.concat_ws(":", F.lit(dataset), F.lit(part), F.col(key).cast("string"))


def flatten(conflict_rows: DataFrame, dataset: str, part: str = "feature") -> DataFrame:
    """One row per version of a conflict: ``label`` as ``ds:part:key:version`` and the row."""
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("row")) for v in VERSIONS])
    return (
        conflict_rows.select("key", F.explode(versions).alias("v"))
        .filter(F.col("v.row").isNotNull())
        .select("key", "v.version", F.concat_ws(":", label(dataset, part), F.col("v.version")).alias("label"), "v.row")
    )


def resolve_with(conflict_rows: DataFrame, version: str, keys: DataFrame | None = None) -> DataFrame:
    """Resolves ``(key, row)``; ``version`` is ancestor, ours, theirs or delete.

    A resolve with a NULL row deletes. ``keys`` restricts which conflicts are resolved.
    """
    rows = conflict_rows if keys is None else conflict_rows.join(keys.select("key").distinct(), "key", "left_semi")
    kind = rows.schema["ours"].dataType
    row = F.lit(None).cast(kind) if version == "delete" else F.col(version)
    return rows.select("key", row.alias("row"))


def resolve_from(conflict_rows: DataFrame, edited: DataFrame, pk: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """Resolves from edited rows (a workspace or a file); a conflict may get several rows.

    ``edited`` has the table's columns and, when a conflict is answered by rows of other
    keys, a ``conflict_key``. ``keys`` (column ``key``) names the conflicts that are being
    answered; one of them without an edited row is resolved as a delete. Without it, only
    conflicts that have an edited row are.
    """
    cols = [c for c in edited.columns if c != "conflict_key"]
    at = F.col("conflict_key") if "conflict_key" in edited.columns else key_of(pk)
    rows = edited.select(at.alias("key"), F.struct(*cols).alias("row"))
    if keys is None:
        return conflict_rows.select("key").join(rows, "key")
    named = conflict_rows.select("key").join(keys.select("key").distinct(), "key", "left_semi")
    return named.join(rows, "key", "left")


def unresolved(conflict_rows: DataFrame, resolves: DataFrame) -> DataFrame:
    return conflict_rows.join(resolves.select("key").distinct(), "key", "left_anti")


def renumber(
    conflict_rows: DataFrame,
    ours: DataFrame,
    theirs: DataFrame,
    pk: str,
    side: str = "theirs",
    resolves: DataFrame | None = None,
) -> DataFrame:
    """Resolves of insert/insert conflicts that keep one side and give the other new keys.

    New keys run upward from above every key of both sides and of earlier resolves, in
    key order. Two rows per conflict: the kept one and the renumbered one.
    """
    keep = "ours" if side == "theirs" else "theirs"
    clashing = conflict_rows.filter(F.col("outcome") == "conflict_insert_insert")
    tops = [d.agg(F.max(pk).alias("_m")) for d in (ours, theirs)]
    if resolves is not None:
        tops.append(resolves.filter(F.col("row").isNotNull()).agg(F.max(F.col("row")[pk]).alias("_m")))
    start = reduce(DataFrame.unionByName, tops).agg(F.coalesce(F.max("_m") + 1, F.lit(0)).alias("_start"))
    numbered = number_all(clashing.select("key", keep, side), ["key"], "_n").withColumn("_start", start.scalar())
    fresh = (F.col("_start") + F.col("_n") - 1).cast("bigint")
    moved = F.col(side).withField(pk, fresh)
    both = numbered.select(
        "key",
        F.explode(
            F.array(
                F.struct(F.lit(keep).alias("from"), F.col(keep).alias("row")),
                F.struct(F.lit(side).alias("from"), moved.alias("row")),
            )
        ).alias("_e"),
    )
    return both.select("key", "_e.from", "_e.row")


def merged_snapshot(merged: DataFrame, resolves: DataFrame | None = None, unresolved_as: str | None = "ours") -> DataFrame:
    """Rows so far: clean rows, resolves, and what an unresolved conflict counts as.

    Unresolved rows and meta items count as ours, unresolved tiles (``None``) as absent.
    """
    parts = [clean_rows(merged)]
    open_rows = conflicts(merged)
    if resolves is not None:
        parts.append(resolves.filter(F.col("row").isNotNull()).select("row.*"))
        open_rows = unresolved(open_rows, resolves)
    if unresolved_as is not None:
        parts.append(open_rows.filter(F.col(unresolved_as).isNotNull()).select(f"{unresolved_as}.*"))
    return reduce(DataFrame.unionByName, parts)


def finish(merged: DataFrame, resolves: DataFrame) -> DataFrame:
    """The merged relation; the job fails while a conflict is unresolved."""
    left = unresolved(conflicts(merged), resolves).agg(F.count(F.lit(1)).alias("_left"))
    message = F.concat(F.lit("unresolved conflicts: "), F.col("_left").cast("string"))
    error = left.select(F.when(F.col("_left") > 0, F.raise_error(message)).cast("string"))
    return merged_snapshot(merged, resolves, None).filter(error.scalar().isNull())


def merge_kind(base: str | None, ours: str, theirs: str, fast_forward: str = "auto") -> str:
    """``unrelated``, ``no_op``, ``fast_forward`` or ``merge`` for three commit ids.

    ``fast_forward`` is ``auto``, ``never`` or ``only``.
    """
    if base is None:
        return "unrelated"
    if base == theirs:
        return "no_op"
    if base == ours and fast_forward != "never":
        return "fast_forward"
    if fast_forward == "only":
        raise ValueError("cannot fast-forward: both sides have changed")
    return "merge"
