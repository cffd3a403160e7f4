"""Schema operators that run as jobs: validation, column-list diffs, path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diffing import key_text
from tidemark.schema import VersionedSchema

#: Text forms of date and time values (fixed values).
PATTERNS = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}:\d{2}(\.\d+)?Z?$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z?$",
    "interval": r"^P(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$",
}

#: What Spark types hold the stored form of each column type (fixed values).
HOLDERS = {
    "boolean": {"boolean"},
    "blob": {"binary"},
    "date": {"string", "date"},
    "float": {"float", "double", "tinyint", "smallint", "int", "bigint"},
    "geometry": {"binary"},
    "integer": {"tinyint", "smallint", "int", "bigint"},
    "interval": {"string"},
    "numeric": {"string", "decimal"},
    "text": {"string"},
    "time": {"string"},
    "timestamp": {"string", "timestamp", "timestamp_ntz"},
}


def fits_integer(value: Column, size: int) -> Column:
    """Whether a number fits a signed integer of ``size`` bits."""
    if size >= 64:
        return F.lit(True)
    return value.between(-(1 << (size - 1)), (1 << (size - 1)) - 1)


def violation(col, value: Column, held_as: str) -> Column:
    """Name of the rule a value breaks, NULL when it is fine. NULL values always are."""
    held = held_as.split("(")[0]
    if held not in HOLDERS[col.data_type]:
        broken = F.lit("type")
    elif col.data_type in PATTERNS and held == "string":
        broken = F.when(~value.rlike(PATTERNS[col.data_type]), F.lit("pattern"))
    elif col.data_type == "integer" and col.info.get("size"):
        broken = F.when(~fits_integer(value, col.info["size"]), F.lit("range"))
    elif col.data_type == "text" and col.info.get("length"):
        broken = F.when(F.char_length(value) > col.info["length"], F.lit("length"))
    elif col.data_type == "blob" and col.info.get("length"):
        broken = F.when(F.octet_length(value) > col.info["length"], F.lit("length"))
    else:
        broken = F.lit(None).cast("string")
    return F.when(value.isNotNull(), broken)


def violations(df: DataFrame, schema: VersionedSchema) -> DataFrame:
    """One row per broken value: ``key, column, value, rule``."""
    held = dict(df.dtypes)
    entries = []
    for c in schema.columns:
        rule = violation(c, F.col(c.name), held[c.name])
        entries.append(
            F.when(
                rule.isNotNull(),
                F.struct(
                    F.lit(c.name).alias("column"),
                    F.col(c.name).cast("string").alias("value"),
                    rule.alias("rule"),
                ),
            )
        )
    found = F.array_compact(F.array(*entries))
    return (
        df.select(key_text(schema.pk).alias("key"), F.explode(found).alias("v"))
        .select("key", "v.column", "v.value", "v.rule")
    )


def violation_examples(df: DataFrame, schema: VersionedSchema) -> DataFrame:
    """The violation of the smallest key per column, with the number of broken values."""
    found = violations(df, schema)
    return found.groupBy("column").agg(
        F.min(F.struct("key", "value", "rule")).alias("e"), F.count(F.lit(1)).alias("n")
    ).select("column", "e.key", "e.value", "e.rule", "n")


COLUMN_LIST = ["id", "position", "name", "pk_index", "facts"]


def schema_diff(old: DataFrame, new: DataFrame, by: list[str] = []) -> DataFrame:
    """Id-wise comparison of column lists (``id, position, name, pk_index, facts``)."""
    keys = [*by, "id"]
    a = old.select(*keys, F.lit(True).alias("_o"), *[F.col(c).alias(f"old_{c}") for c in COLUMN_LIST[1:]])
    b = new.select(*keys, F.lit(True).alias("_n"), *[F.col(c).alias(f"new_{c}") for c in COLUMN_LIST[1:]])
    both = a.join(b, keys, "full_outer")
    kept = F.col("_o").isNotNull() & F.col("_n").isNotNull()

    def differs(name: str) -> Column:
        return kept & ~F.col(f"old_{name}").eqNullSafe(F.col(f"new_{name}"))

    return both.select(
        *keys,
        F.col("_o").isNull().alias("inserted"),
        F.col("_n").isNull().alias("deleted"),
        differs("position").alias("moved"),
        differs("name").alias("renamed"),
        differs("facts").alias("retyped"),
        differs("pk_index").alias("rekeyed"),
    )


def schema_change_counts(changes: DataFrame, by: list[str] = []) -> DataFrame:
    names = {
        "inserted": "inserts",
        "deleted": "deletes",
        "moved": "position_updates",
        "renamed": "name_updates",
        "retyped": "type_updates",
        "rekeyed": "pk_updates",
    }
    sums = [F.sum(F.col(c).cast("bigint")).alias(n) for c, n in names.items()]
    return changes.groupBy(*by).agg(*sums) if by else changes.agg(*sums)


#: Rules for dataset paths (fixed values).
FORBIDDEN_CHARACTERS = r'[:<>"|?*\x00-\x1f]'
RESERVED_NAMES = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]


def path_problem(path: Column) -> Column:
    """The first rule a dataset path breaks, NULL when it is a good path."""
    parts = F.split(path, "/")
    return (
        F.when((path == "") | F.exists(parts, lambda p: p == ""), F.lit("empty component"))
        .when(path.rlike(FORBIDDEN_CHARACTERS), F.lit("forbidden character"))
        .when(F.exists(parts, lambda p: p.startswith(".") | p.endswith(".") | p.endswith(" ")), F.lit("bad component end"))
        .when(F.exists(parts, lambda p: F.upper(p).isin(RESERVED_NAMES)), F.lit("reserved name"))
    )


def path_report(paths: DataFrame, column: str = "path") -> DataFrame:
    """Problems of each path, and how many other paths clash with it when case is ignored."""
    distinct = paths.select(column).distinct()
    folded = distinct.withColumn("_folded", F.lower(column))
    sizes = folded.groupBy("_folded").agg((F.count(F.lit(1)) - 1).alias("clashes"))
    return folded.join(sizes, "_folded").select(column, path_problem(F.col(column)).alias("problem"), "clashes")
