"""Keyed comparison of two versions of a relation.

A delta frame has the columns ``old_key, new_key, change_type, old, new, flags``: the
``old`` and ``new`` structs hold whole rows and are NULL where the side is absent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import fingerprint
from tidemark.schema import VersionedSchema

#: Flag bits of a delta (fixed values).
WORKSPACE_EDIT = 0x1
BINARY_FILE = 0x2

DELTA_COLUMNS = ["old_key", "new_key", "change_type", "old", "new", "flags"]


def key_of(pk: Sequence[str]) -> Column:
    """The key of a row: the column itself, or a struct for a compound key."""
    return F.col(pk[0]) if len(pk) == 1 else F.struct(*pk)


def key_text(pk: Sequence[str]) -> Column:
    """The key as text; parts of a compound key are joined by a comma."""
    return F.concat_ws(",", *[F.col(c).cast("string") for c in pk])


def change_type(has_old: Column, has_new: Column) -> Column:
    return (
        F.when(has_old & has_new, F.lit("update"))
        .when(has_new, F.lit("insert"))
        .when(has_old, F.lit("delete"))
    )


def snapshot_side(df: DataFrame, pk: Sequence[str], side: str, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    return df.select(key_of(pk).alias(f"{side}_key"), F.struct(*cols).alias(side))


def through(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``old`` with the columns of ``new``: found by name, brought to its order and types.

    A column that only ``new`` has is NULL, one that only ``old`` has is left out: adding or
    dropping a column changes the schema, not every row.
    """
    if old.dtypes == new.dtypes:
        return old
    return old.select(*[(F.col(f"`{f.name}`") if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in new.schema.fields])


def diff_versions(old: DataFrame, old_schema: VersionedSchema, new: DataFrame, new_schema: VersionedSchema, *, flags: int = 0, strategy: str = "wide") -> DataFrame:
    """Feature deltas across a change of schema: columns are the same where their ids are, whatever their names and places.

    Both halves of a delta have the columns of the newer schema. Where the key columns are
    others, no row can be met by its key: all old rows go and all new ones come, each with its own columns
    (a half has the columns of either version then).
    """
    if not old_schema.pk_compatible(new_schema):
        gone, come = all_rows(old, old_schema.pk, "delete", flags), all_rows(new, new_schema.pk, "insert", flags)
        old_type, new_type = gone.schema["old"].dataType, come.schema["new"].dataType
        key = gone.schema["old_key"].dataType, come.schema["new_key"].dataType
        gone = gone.withColumns({"new": F.lit(None).cast(new_type), "new_key": F.lit(None).cast(key[1])})
        come = come.withColumns({"old": F.lit(None).cast(old_type), "old_key": F.lit(None).cast(key[0])})
        return gone.select(*DELTA_COLUMNS).unionByName(come.select(*DELTA_COLUMNS))
    now = new_schema.by_id()
    names = {c.name: now[c.id].name for c in old_schema.columns if c.id in now}
    met = old.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
    return diff(met, new.select(*new_schema.names), new_schema.pk, flags=flags, strategy=strategy)


def schema_delta(dataset: Column, old_schema: VersionedSchema | None, new_schema: VersionedSchema | None, spark: SparkSession) -> DataFrame:
    """The meta delta that goes with a diff across schemas: no row where both are the same."""
    old, new = (None if s is None else s.to_json() for s in (old_schema, new_schema))
    one = spark.range(1).select(dataset.alias("dataset"), F.lit("schema.json").alias("item"), F.lit(old).cast("string").alias("old_value"), F.lit(new).cast("string").alias("new_value"))
    kind = change_type(F.col("old_value").isNotNull(), F.col("new_value").isNotNull())
    return one.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("dataset", "item", kind.alias("change_type"), "old_value", "new_value")


def join_versions(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Both versions side by side on the key, changed or not; columns are met by name."""
    old = through(old, new)
    a = snapshot_side(old, pk, "old")
    b = snapshot_side(new, pk, "new")
    return a.join(b, F.col("old_key") == F.col("new_key"), "full_outer")


def diff(
    old: DataFrame | None,
    new: DataFrame | None,
    pk: Sequence[str],
    *,
    flags: int = 0,
    strategy: str = "wide",
) -> DataFrame:
    """Inserts, updates and deletes that lead from ``old`` to ``new``.

    Either side may be absent, which makes every row of the other an insert or a delete.

    ``wide`` moves each row once through one full outer join. ``hash_first`` joins only
    keys and 128-bit fingerprints, then fetches whole rows of the changed keys: the better
    plan when rows are wide and few of them changed, as the wide columns of unchanged
    rows are never shuffled.
    """
    if new is None:
        return all_rows(old, pk, "delete", flags)
    if old is None:
        return all_rows(new, pk, "insert", flags)
    old = through(old, new)
    if strategy == "hash_first":
        changed = changed_keys(old, new, pk)
        a = snapshot_side(old, pk, "_old")
        b = snapshot_side(new, pk, "_new")
        joined = (
            changed.join(a, F.col("old_key") == F.col("_old_key"), "left")
            .join(b, F.col("new_key") == F.col("_new_key"), "left")
            .withColumnsRenamed({"_old": "old", "_new": "new"})
        )
        return joined.withColumn("flags", F.lit(flags)).select(*DELTA_COLUMNS)
    both = join_versions(old, new, pk).filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(
        "old_key",
        "new_key",
        change_type(F.col("old_key").isNotNull(), F.col("new_key").isNotNull()).alias("change_type"),
        "old",
        "new",
        F.lit(flags).alias("flags"),
    )


def changed_keys(old: DataFrame, new: DataFrame, pk: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``old_key, new_key, change_type`` of the changed rows; only keys and hashes are shuffled.

    Columns are met by name; ``columns`` limits the comparison to some.
    """
    old = through(old, new)
    cols = [c for c in (columns or old.columns) if c not in pk]
    new_cols = [c for c in (columns or new.columns) if c not in pk]
    h1, h2 = fingerprint(cols)
    g1, g2 = fingerprint(new_cols)
    a = old.select(key_of(pk).alias("old_key"), h1.alias("_h1"), h2.alias("_h2"))
    b = new.select(key_of(pk).alias("new_key"), g1.alias("_g1"), g2.alias("_g2"))
    joined = a.join(b, F.col("old_key") == F.col("new_key"), "full_outer")
    same = F.col("_h1").eqNullSafe(F.col("_g1")) & F.col("_h2").eqNullSafe(F.col("_g2"))
    return joined.filter(~same).select(
        "old_key",
        "new_key",
        change_type(F.col("old_key").isNotNull(), F.col("new_key").isNotNull()).alias("change_type"),
    )


def all_rows(df: DataFrame, pk: Sequence[str], kind: str, flags: int = 0) -> DataFrame:
    """Every row as an insert (new dataset) or a delete (dropped or re-keyed dataset)."""
    row = F.struct(*df.columns)
    kept, empty = ("new", "old") if kind == "insert" else ("old", "new")
    out = df.select(key_of(pk).alias(f"{kept}_key"), row.alias(kept))
    types = dict(out.dtypes)
    return out.select(
        *[
            F.col(c) if c in out.columns else F.lit(None).cast(types[c.replace(empty, kept)]).alias(c)
            for c in ("old_key", "new_key")
        ],
        F.lit(kind).alias("change_type"),
        *[F.col(c) if c in out.columns else F.lit(None).cast(types[kept]).alias(c) for c in ("old", "new")],
        F.lit(flags).alias("flags"),
    ).select(*DELTA_COLUMNS)


def diff_at_keys(old: DataFrame, new: DataFrame, pk: Sequence[str], keys: Sequence, flags: int = 0) -> DataFrame:
    """Diff of a few named keys: both sides are filtered before the join, down to the scan.

    Text keys are also tried as numbers when the key column is one.
    """
    wanted = key_text(pk).isin([str(k) for k in keys]) if len(pk) > 1 else _key_in(old, pk[0], keys)
    return diff(old.filter(wanted), new.filter(wanted), pk, flags=flags)


def _key_in(df: DataFrame, pk: str, keys: Sequence) -> Column:
    kind = dict(df.dtypes)[pk]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        typed = [int(k) for k in keys if str(k).lstrip("-").isdigit()]
        return F.col(pk).isin(typed) if typed else F.lit(False)
    return F.col(pk).isin([str(k) for k in keys]) if kind == "string" else F.col(pk).isin(list(keys))


def field_changes(delta: DataFrame) -> DataFrame:
    """One row per field that differs in an update: ``old_key, new_key, field, old_value, new_value``."""
    old_fields = delta.schema["old"].dataType.fieldNames()
    new_fields = delta.schema["new"].dataType.fieldNames()
    names = list(old_fields) + [f for f in new_fields if f not in old_fields]

    def side(struct: str, fields: list[str], name: str) -> Column:
        return F.col(struct)[name] if name in fields else F.lit(None)

    entries = [
        F.when(
            ~side("old", old_fields, n).eqNullSafe(side("new", new_fields, n)),
            F.struct(
                F.lit(n).alias("field"),
                side("old", old_fields, n).cast("string").alias("old_value"),
                side("new", new_fields, n).cast("string").alias("new_value"),
            ),
        )
        for n in names
    ]
    changed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return (
        delta.filter(F.col("change_type") == "update")
        .select("old_key", "new_key", F.explode(changed).alias("_e"))
        .select("old_key", "new_key", "_e.field", "_e.old_value", "_e.new_value")
    )


def diff_maps(old: DataFrame, new: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Differences of two keyed text maps held as rows (meta items, files): one row per item."""
    a = old.select(*by, F.col(value).alias("old_value"), F.lit(True).alias("_o"))
    b = new.select(*by, F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    both = a.join(b, list(by), "full_outer").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    kind = change_type(F.col("_o").isNotNull(), F.col("_n").isNotNull())
    return both.select(*by, kind.alias("change_type"), "old_value", "new_value")


def repository_diff(versions: dict[str, tuple[DataFrame | None, DataFrame | None, Sequence[str]]], meta: DataFrame | None = None) -> DataFrame:
    """Diffs of many datasets as one frame; rows and keys as JSON and text, since shapes differ.

    ``meta`` (dataset, item, change_type, old_value, new_value) adds the part ``meta``, keyed by item.
    """
    parts = []
    if meta is not None:
        there = lambda c, kind: F.when(F.col("change_type") != kind, F.col(c))
        parts.append(meta.select(
            "dataset", F.lit("meta").alias("part"), there("item", "insert").alias("old_key"), there("item", "delete").alias("new_key"), "change_type",
            F.col("old_value").alias("old"), F.col("new_value").alias("new"), F.lit(0).alias("flags"),
        ))
    for path, (old, new, pk) in versions.items():
        d = diff(old, new, pk)
        parts.append(
            d.select(
                F.lit(path).alias("dataset"),
                F.lit("feature").alias("part"),
                _text_key(d, "old_key").alias("old_key"),
                _text_key(d, "new_key").alias("new_key"),
                "change_type",
                F.to_json("old", {"ignoreNullFields": "false"}).alias("old"),
                F.to_json("new", {"ignoreNullFields": "false"}).alias("new"),
                "flags",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _text_key(df: DataFrame, name: str) -> Column:
    field = df.schema[name].dataType
    if hasattr(field, "fieldNames"):
        return F.concat_ws(",", *[F.col(name)[n].cast("string") for n in field.fieldNames()])
    return F.col(name).cast("string")


def has_changes(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """One row, one flag: is anything different."""
    changed = changed_keys(old, new, pk).limit(1)
    return changed.agg((F.count(F.lit(1)) > 0).alias("has_changes"))


def checksum(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Order-free checksum of a relation with unique keys; one map-side aggregate, no shuffle of rows."""
    h1, h2 = fingerprint([*pk, *[c for c in df.columns if c not in pk]])
    return df.select(h1.alias("_h1"), h2.alias("_h2")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("_h1").alias("x1"), F.bit_xor("_h2").alias("x2")
    )


def data_changed(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Whether two versions differ, from their checksums alone."""
    a = checksum(old, pk).select(F.struct("n", "x1", "x2").alias("_a"), F.lit(1).alias("_one"))
    b = checksum(new, pk).select(F.struct("n", "x1", "x2").alias("_b"), F.lit(1).alias("_one"))
    return a.join(b, "_one").select((~F.col("_a").eqNullSafe(F.col("_b"))).alias("data_changed"))
