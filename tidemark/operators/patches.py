"""Patches: parsed feature changes, conflict checks, and all-or-nothing application.

A parsed patch frame has ``key`` (typed), the halves ``minus_minus, minus, plus,
plus_plus`` as row structs, and ``present``: the names of the fields the new side gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut

HALVES = {"--": "minus_minus", "-": "minus", "+": "plus", "++": "plus_plus"}


def parse_changes(raw: DataFrame, row_type: T.StructType, pk: str, text: str = "change") -> DataFrame:
    """Feature changes as JSON text, one per row, to typed halves with a validity check."""
    halves = T.StructType([T.StructField(m, row_type) for m in HALVES] + [T.StructField("*", row_type)])
    present = T.StructType([T.StructField(m, T.MapType(T.StringType(), T.StringType())) for m in HALVES])
    parsed = raw.withColumn("_h", F.from_json(text, halves)).withColumn("_p", F.from_json(text, present))

    def half(mark: str) -> Column:
        return F.col("_h").getField(mark)

    def fields(mark: str) -> Column:
        return F.map_keys(F.col("_p").getField(mark))

    given = F.flatten(F.array_compact(F.array(*[fields(m) for m in HALVES])))
    unknown = F.array_sort(F.array_distinct(F.array_except(given, F.array(*[F.lit(n) for n in row_type.fieldNames()]))))
    out = parsed.select(
        *raw.columns,
        *[half(m).alias(name) for m, name in HALVES.items()],
        F.coalesce(fields("++"), fields("+")).alias("present"),
        fields("-").alias("old_present"),
        half("*").isNotNull().alias("_star"),
        unknown.alias("_unknown"),
        F.col(text).alias("_text"),
    )
    has = {m: F.col(n).isNotNull() for m, n in HALVES.items()}
    key = F.coalesce(*[F.col(n)[pk] for n in ("minus_minus", "minus", "plus_plus", "plus")])
    kind = (
        F.when(has["++"], "insert")
        .when(has["--"], "delete")
        .when(has["-"] & has["+"], "update")
        .when(has["+"], "insert")
        .when(has["-"], "delete")
    )
    invalid = (
        F.when(F.col("_star"), F.lit("star is not allowed"))
        .when(has["++"] & has["--"], F.lit("both ++ and --"))
        .when(kind.isNull(), F.when(F.get_json_object("_text", "$").isNull(), F.lit("no JSON object")).otherwise(F.lit("empty change")))
        .when(F.size("_unknown") > 0, F.concat(F.lit("unknown fields: "), F.concat_ws(",", "_unknown")))
        .when(key.isNull(), F.lit("no primary key"))
    )
    return out.select(
        "*",
        key.alias("key"),
        kind.alias("change_type"),
        (has["+"] & ~has["-"] & ~has["++"]).alias("lone_plus"),
        invalid.alias("invalid"),
    ).drop("_star", "_unknown", "_text")


def as_delta(parsed: DataFrame, pk: str) -> DataFrame:
    """Delta frame of a parsed patch; a change that is not valid fails the job, none is left out."""
    old = F.coalesce("minus_minus", "minus")
    new = F.coalesce("plus_plus", "plus")
    error = F.when(F.col("invalid").isNotNull(), F.raise_error(F.concat(F.lit("invalid change in patch: "), F.col("invalid"))))
    return parsed.withColumn("_error", error.cast("string")).filter(F.col("_error").isNull()).select(
        old[pk].alias("old_key"),
        new[pk].alias("new_key"),
        "change_type",
        old.alias("old"),
        new.alias("new"),
        F.lit(0).alias("flags"),
        *[c for c in ("present", "old_present", "lone_plus") if c in parsed.columns],
    )


def fill_partial(delta: DataFrame, base: DataFrame, pk: str) -> DataFrame:
    """Fields a partial row does not name are taken from the patch's base version.

    ``missing_fields`` names what is still unknown: a partial insert without a base row.
    """
    columns = base.columns
    b = base.select(F.col(pk).alias("_bk"), F.struct(*columns).alias("_b"))
    at = F.coalesce("old_key", "new_key")
    joined = delta.join(b, at == F.col("_bk"), "left")

    def filled(side: str, present: str) -> Column:
        given = F.col(present)
        cols = [
            F.when(F.array_contains(given, c), F.col(side)[c]).otherwise(F.col("_b")[c]).alias(c) for c in columns
        ]
        complete = given.isNull() | (F.size(F.array_except(F.array(*[F.lit(c) for c in columns]), given)) == 0)
        return F.when(F.col(side).isNull() | complete, F.col(side)).otherwise(F.struct(*cols))

    absent = F.array_except(F.array(*[F.lit(c) for c in columns]), F.coalesce("present", F.array().cast("array<string>")))
    unknown = F.when(
        F.col("new").isNotNull() & F.col("_b").isNull() & F.col("present").isNotNull() & (F.size(absent) > 0),
        F.concat_ws(",", F.array_sort(absent)),
    )
    return joined.select(
        "old_key",
        "new_key",
        "change_type",
        filled("old", "old_present").alias("old"),
        filled("new", "present").alias("new"),
        "flags",
        "present",
        "lone_plus",
        unknown.alias("missing_fields"),
    )


def conflicts(delta: DataFrame, current: DataFrame, pk: str, base: DataFrame | None = None) -> DataFrame:
    """One row per delta that cannot be applied: ``key, change_type, reason``.

    Deletes do not compare old values. An insert of a present key is allowed only as an
    edit given against ``base``: a lone plus whose row has not changed since.
    """
    columns = current.columns
    c = current.select(F.col(pk).alias("_ck"), F.struct(*columns).alias("_c"))
    at = F.when(F.col("change_type") == "insert", F.col("new_key")).otherwise(F.col("old_key"))
    joined = delta.withColumn("_at", at).join(c, F.col("_at") == F.col("_ck"), "left")
    here = F.col("_ck").isNotNull()
    kind = F.col("change_type")
    stale = ~F.col("_c").eqNullSafe(F.col("old"))
    if base is None:
        insert_conflict = F.lit("insert of existing key")
    else:
        b = base.select(F.col(pk).alias("_bk"), F.struct(*columns).alias("_b"))
        joined = joined.join(b, F.col("_at") == F.col("_bk"), "left")
        overlaid = F.struct(
            *[F.when(F.array_contains("present", n), F.col("new")[n]).otherwise(F.col("_c")[n]).alias(n) for n in columns]
        )
        same = F.col("_b").eqNullSafe(F.col("_c")) | F.col("_b").eqNullSafe(overlaid)
        unchanged = F.col("_bk").isNotNull() & same
        insert_conflict = F.when(~unchanged, F.lit("modified since patch"))
    reason = (
        F.when((kind == "delete") & ~here, F.lit("delete of missing key"))
        .when((kind == "update") & ~here, F.lit("update of missing key"))
        .when((kind == "update") & stale, F.lit("update of changed row"))
        .when((kind == "insert") & here, insert_conflict)
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        F.col("_at").alias("key"), "change_type", "reason"
    )


def apply(delta: DataFrame, current: DataFrame, pk: str) -> DataFrame:
    """The relation after the deltas; conflicts are not looked at here."""
    gone = delta.select(F.explode(F.array_compact(F.array("old_key", "new_key"))).alias(pk)).distinct()
    kept = current.join(gone, pk, "left_anti")
    added = delta.filter(F.col("new_key").isNotNull()).select("new.*")
    return kept.unionByName(added)


def apply_checked(delta: DataFrame, current: DataFrame, pk: str, base: DataFrame | None = None) -> DataFrame:
    """As :func:`apply`, but any conflict fails the job before a row is returned.

    Rows that name only some of their fields are filled from ``base`` first; a field that is still
    unknown is a conflict too. The check is a scalar subquery, so nothing is applied when it
    is not zero. The patch is needed for the check, for the rows that go and for those that
    come: it is parsed once and written.
    """
    missing = None
    if "present" in delta.columns:
        delta = fill_partial(delta, base if base is not None else current.filter(F.lit(False)), pk)
    delta = cut(delta)
    if "missing_fields" in delta.columns:
        missing = delta.filter(F.col("missing_fields").isNotNull()).select(F.lit("missing fields").alias("reason"))
    found = conflicts(delta, current, pk, base).select("reason")
    bad = (found if missing is None else found.unionByName(missing)).agg(F.count(F.lit(1)).alias("_bad"))
    message = F.concat(F.lit("patch does not apply, conflicts: "), F.col("_bad").cast("string"))
    error = bad.select(F.when(F.col("_bad") > 0, F.raise_error(message)).cast("string"))
    return apply(delta, current, pk).filter(error.scalar().isNull())


def classify_meta(meta: DataFrame, existing: DataFrame) -> DataFrame:
    """What a patch does to each dataset, read off the halves of its schema item.

    ``meta`` has ``dataset, has_old, has_new`` of the schema item; ``existing`` lists datasets.
    """
    kind = (
        F.when(~F.col("has_old") & F.col("has_new"), "create_dataset")
        .when(F.col("has_old") & ~F.col("has_new"), "delete_dataset")
        .otherwise("meta_update")
    )
    known = existing.select("dataset").distinct().withColumn("_known", F.lit(True))
    joined = meta.withColumn("meta_change", kind).join(known, "dataset", "left")
    there = F.col("_known").isNotNull()
    problem = (
        F.when((F.col("meta_change") == "create_dataset") & there, "dataset exists")
        .when((F.col("meta_change") != "create_dataset") & ~there, "no such dataset")
    )
    return joined.select("dataset", "meta_change", problem.alias("problem"))


def meta_conflicts(delta: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Conflicts of meta deltas (``old_value, new_value`` text) with the current items."""
    joined = delta.join(current.select(*by, F.col("value").alias("_cur")), list(by), "left")
    kind, here = F.col("change_type"), F.col("_cur").isNotNull()
    reason = (
        F.when((kind == "delete") & ~here, "delete of missing item")
        .when((kind == "update") & ~here, "update of missing item")
        .when((kind == "insert") & here, "insert of existing item")
        .when((kind == "update") & (F.col("_cur") != F.col("old_value")), "update of changed item")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*by, "change_type", "reason")


def apply_meta(delta: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = current.join(delta.select(*by), list(by), "left_anti").select(*by, "value")
    added = delta.filter(F.col("new_value").isNotNull()).select(*by, F.col("new_value").alias("value"))
    return kept.unionByName(added)


def apply_files(files: DataFrame, changes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files after attaching and removing; a path inside a dataset fails the job."""
    guarded = changes.join(
        datasets.select(F.col("dataset").alias("_ds")), F.substring_index("path", "/", 1) == F.col("_ds"), "left"
    ).withColumn(
        "_error", F.when(F.col("_ds").isNotNull(), F.raise_error(F.concat(F.lit("file inside a dataset: "), F.col("path")))).cast("string")
    ).filter(F.col("_error").isNull()).drop("_ds", "_error")
    kept = files.join(guarded.select("path"), "path", "left_anti")
    return kept.unionByName(guarded.filter(F.col("content").isNotNull()).select(*files.columns))


def guard_reprojected(delta: DataFrame, crs: str | None, base: DataFrame | None) -> DataFrame:
    """Rules of a patch in another reference system: it needs a base and has no full updates."""
    if crs is None:
        return delta
    if base is None:
        raise ValueError("a patch with its own reference system needs a base version")
    bad = F.when(F.col("change_type") == "update", F.raise_error(F.lit("updates of a reprojected patch must not give old rows")))
    return delta.withColumn("_e", bad.cast("string")).filter(F.col("_e").isNull()).drop("_e")
