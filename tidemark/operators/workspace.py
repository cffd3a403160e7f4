"""Workspaces: editable copies of a dataset with a list of the keys that were touched.

``base`` is the committed version, ``edited`` the workspace table, ``dirty`` a frame with
the touched keys as text in ``pk`` (and ``table_name`` where it spans tables).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diffing import DELTA_COLUMNS, WORKSPACE_EDIT, change_type, key_text


def _dirty_keys(dirty: DataFrame) -> DataFrame:
    return dirty.select(F.col("pk").cast("string").alias("_key")).distinct()


def dirty_rows(edited: DataFrame, dirty: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Touched keys with their current row; a NULL row means the row was deleted."""
    rows = edited.select(key_text(pk).alias("_key"), F.struct(*edited.columns).alias("row"))
    return _dirty_keys(dirty).join(rows, "_key", "left").select(F.col("_key").alias("key"), "row")


def workspace_diff(base: DataFrame, edited: DataFrame, dirty: DataFrame, pk: str) -> DataFrame:
    """Deltas of the touched rows; rows changed and changed back are dropped.

    Both sides are cut down to touched keys before they meet, so neither table is
    shuffled when the list of touched keys is small enough to be broadcast.
    """
    keys = _dirty_keys(dirty)
    text = F.col(pk).cast("string")
    old = base.select(text.alias("_key"), F.struct(*base.columns).alias("old")).join(keys, "_key", "left_semi")
    new = edited.select(text.alias("_key"), F.struct(*edited.columns).alias("new")).join(keys, "_key", "left_semi")
    both = old.join(new, "_key", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(
        F.col("old")[pk].alias("old_key"),
        F.col("new")[pk].alias("new_key"),
        change_type(F.col("old").isNotNull(), F.col("new").isNotNull()).alias("change_type"),
        "old",
        "new",
        F.lit(WORKSPACE_EDIT).alias("flags"),
    ).select(*DELTA_COLUMNS)


def is_dirty(base: DataFrame, edited: DataFrame, dirty: DataFrame, pk: str) -> DataFrame:
    """One row, one flag; the search ends at the first real difference."""
    first = workspace_diff(base, edited, dirty, pk).limit(1)
    return first.agg((F.count(F.lit(1)) > 0).alias("is_dirty"))


def tracked_counts(dirty: DataFrame) -> DataFrame:
    return dirty.groupBy("table_name").agg(F.count_distinct("pk").alias("n"))


def touched_by(log: DataFrame, key: str, old_key: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Keys an edit log touches; a key change touches the old key too."""
    keys = F.array(F.col(key), F.col(old_key)) if old_key else F.array(F.col(key))
    return log.select(*by, F.explode(F.array_compact(keys)).alias("pk")).select(*by, F.col("pk").cast("string")).distinct()


def apply_log(table: DataFrame, log: DataFrame, pk: str, order: str) -> DataFrame:
    """The table after an edit log: the latest edit of each key wins (``op`` is put or del)."""
    values = [c for c in table.columns if c != pk]
    latest = log.groupBy(pk).agg(F.max_by(F.struct("op", *values), F.col(order)).alias("_e"))
    kept = table.join(latest.select(pk), pk, "left_anti")
    put = latest.filter(F.col("_e.op") == "put").select(pk, *[F.col(f"_e.{v}").alias(v) for v in values])
    return kept.unionByName(put.select(*table.columns))


def upsert(target: DataFrame, source: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Insert rows, or overwrite those with the same key."""
    return target.join(source.select(*pk), list(pk), "left_anti").select(*target.columns).unionByName(source)


def discard(base: DataFrame, edited: DataFrame, dirty: DataFrame, pk: str) -> DataFrame:
    """Touched rows go back to their committed state."""
    keys = _dirty_keys(dirty)

    def cut_to(df: DataFrame, how: str) -> DataFrame:
        return df.withColumn("_key", F.col(pk).cast("string")).join(keys, "_key", how).drop("_key").select(*base.columns)

    return cut_to(edited, "left_anti").unionByName(cut_to(base, "left_semi"))


def move_to(current: DataFrame, target: DataFrame, pk: str) -> DataFrame:
    """The workspace table moved from one clean version to another by its changed keys only."""
    from tidemark.operators.diffing import diff
    from tidemark.operators.patches import apply

    return apply(diff(current, target, [pk], strategy="hash_first"), current, pk)


def restore(base: DataFrame, other: DataFrame, pk: str) -> tuple[DataFrame, DataFrame]:
    """Rows of another version written as edits: the table, and the keys that became dirty."""
    from tidemark.operators.algebra import touched_keys
    from tidemark.operators.diffing import diff

    dirty = touched_keys(diff(base, other, [pk])).select(F.col("key").cast("string").alias("pk"))
    return other, dirty


def clear_committed(dirty: DataFrame, committed: DataFrame) -> DataFrame:
    return dirty.join(committed.select("pk").distinct(), "pk", "left_anti")


def drop_outside(edited: DataFrame, outside: DataFrame, pk: str) -> DataFrame:
    return edited.join(outside.select(pk), pk, "left_anti")


def delete_rows(table: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    return table.join(keys.select(pk).distinct(), pk, "left_anti")


def materialise(snapshot: DataFrame, keep: Column | None, path: str, fmt: str = "parquet") -> None:
    """Write the rows of a version that pass the filter as a new workspace table."""
    rows = snapshot if keep is None else snapshot.filter(keep)
    rows.write.format(fmt).mode("errorifexists").save(path)


def check(base: DataFrame, edited: DataFrame, dirty: DataFrame, pk: str) -> DataFrame:
    """Consistency counts: rows of both sides, touched keys, and rows that differ.

    ``untracked_changes`` are differing rows nobody listed as touched: a broken workspace.
    """
    from tidemark.operators.diffing import changed_keys

    changed = changed_keys(base, edited, [pk]).select(F.coalesce("old_key", "new_key").cast("string").alias("_key"))
    flagged = changed.join(_dirty_keys(dirty).withColumn("_d", F.lit(True)), "_key", "left")
    parts = [
        base.agg(F.count(F.lit(1)).alias("n")).select(F.lit("base_rows").alias("measure"), "n"),
        edited.agg(F.count(F.lit(1)).alias("n")).select(F.lit("workspace_rows").alias("measure"), "n"),
        _dirty_keys(dirty).agg(F.count(F.lit(1)).alias("n")).select(F.lit("dirty_keys").alias("measure"), "n"),
        flagged.agg(
            F.count(F.lit(1)).alias("a"), F.sum(F.col("_d").isNull().cast("bigint")).alias("b")
        ).select(
            F.explode(
                F.array(
                    F.struct(F.lit("changed_rows").alias("measure"), F.col("a").alias("n")),
                    F.struct(F.lit("untracked_changes").alias("measure"), F.coalesce("b", F.lit(0)).alias("n")),
                )
            ).alias("s")
        ).select("s.measure", "s.n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_errors(base: DataFrame, edited: DataFrame, dirty: DataFrame, pk: str, limit: int = 100) -> DataFrame:
    """``key, state`` of the first rows, by key as text, that differ though nobody listed them as touched: I, D or U.

    ``limit`` makes it a report; :func:`check` counts them all.
    """
    from tidemark.operators.diffing import changed_keys

    changed = changed_keys(base, edited, [pk]).select(F.coalesce("old_key", "new_key").cast("string").alias("_key"), "change_type")
    missed = changed.join(_dirty_keys(dirty), "_key", "left_anti")
    return missed.select(F.col("_key").alias("key"), F.upper(F.substring("change_type", 1, 1)).alias("state")).orderBy("key").limit(limit)


def status(store, deltas: dict[str, DataFrame], tables: DataFrame, *, ref: str = "main", upstream: str | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """Where a workspace stands: ``section, name, what, n``.

    ``branch``: commits ``ref`` is ahead of and behind ``upstream``. ``merge``: only while there is a merge, that
    is ``conflicts`` are given (none left: n is 0). ``changes``: inserts, updates and deletes of every dataset that
    has any, from its delta. ``untracked``: tables (column ``name``) that no dataset at ``ref`` has.
    """
    from tidemark.operators.sets import untracked

    spark, count = tables.sparkSession, F.count(F.lit(1)).alias("n")
    parts = [
        delta.groupBy(F.col("change_type").alias("what")).agg(count).select(F.lit("changes").alias("section"), F.lit(path).alias("name"), "what", "n")
        for path, delta in deltas.items()
    ]
    known = store.datasets(ref).select(F.col("path").alias("name"))
    parts.append(untracked(tables, known).select(F.lit("untracked").alias("section"), "name", F.lit("table").alias("what"), F.lit(1).cast("bigint").alias("n")))
    if upstream is not None:
        pair = spark.createDataFrame([(store.resolve(ref), store.resolve(upstream))], "branch string, upstream string")
        apart = store.graph().ahead_behind(pair)
        sides = F.explode(F.create_map(F.lit("ahead"), F.col("ahead"), F.lit("behind"), F.col("behind"))).alias("what", "n")
        parts.append(apart.select(F.lit("branch").alias("section"), F.lit(upstream).alias("name"), sides))
    if conflicts is not None:
        parts.append(conflicts.agg(count).select(F.lit("merge").alias("section"), F.lit(ref).alias("name"), F.lit("conflicts").alias("what"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dirty_report(base: DataFrame, edited: DataFrame, dirty: DataFrame, pk: str) -> DataFrame:
    """State of every touched key: I, D, U, or R for one that ended where it began."""
    keys = _dirty_keys(dirty)
    text = F.col(pk).cast("string")
    old = base.select(text.alias("_key"), F.struct(*base.columns).alias("_old"))
    new = edited.select(text.alias("_key"), F.struct(*edited.columns).alias("_new"))
    both = keys.join(old, "_key", "left").join(new, "_key", "left")
    state = (
        F.when(F.col("_old").eqNullSafe(F.col("_new")), "R")
        .when(F.col("_old").isNull(), "I")
        .when(F.col("_new").isNull(), "D")
        .otherwise("U")
    )
    return both.select(F.col("_key").alias("key"), state.alias("state"))


def commit_edits(store, path: str, delta: DataFrame, dirty: DataFrame, message: str, *, clashes: DataFrame | None = None, ref: str = "main") -> DataFrame:
    """Commits workspace edits as a diff; returns the touched keys that are left.

    ``clashes`` are inserts on keys of rows the spatial filter hides (``key_clashes``): while there are any, nothing is
    committed, since they would overwrite rows nobody saw. Keys whose changes are committed are
    no longer touched; those of rows that ended as they began stay listed until they are reset.
    """
    from tidemark.store import DoesNotFit

    if clashes is not None:
        wrong = clashes.limit(5).collect()
        if wrong:
            raise DoesNotFit("keys of rows outside the spatial filter: " + ", ".join(str(r.new_key) for r in wrong))
    store.commit_delta(path, delta, message, ref=ref)
    keys = [F.col(c).cast("string") for c in ("old_key", "new_key")]
    committed = delta.select(F.explode(F.array_compact(F.array(*keys))).alias("pk"))
    return clear_committed(dirty, committed)


def add_untracked(store, path: str, table: DataFrame, pk: list[str], message: str, *, ref: str = "main", meta: dict[str, str] | None = None) -> str:
    """Commits a table nobody tracked as a new dataset.

    Refused without a key, with a key column the table has not, or at a path that is taken or
    no valid one; the commit itself refuses keys that are NULL or come twice.
    """
    if not pk or any(c not in table.columns for c in pk):
        raise ValueError(f"{path} needs key columns of its own: {pk}")
    try:
        head = store.resolve(ref)
    except KeyError:
        head = None
    store.check_new_path(path, head)
    return store.commit({path: table}, message, ref=ref, pks={path: pk}, metas={path: meta or {}})
