"""The algebra of delta frames: concatenate, invert, rename, filter, view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diffing import DELTA_COLUMNS
from tidemark.session import cut


def delta_key() -> Column:
    """The single key a delta is filed under: its old key, else its new key."""
    return F.coalesce(F.col("old_key"), F.col("new_key"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` then ``second``, with a ``conflict`` column for impossible pairs.

    Deltas meet on the key they are filed under, so a rename in ``first`` does not
    meet a later change that is filed under the new key.
    """
    a = first.select(delta_key().alias("_k1"), *[F.col(c).alias(f"a_{c}") for c in DELTA_COLUMNS])
    b = second.select(delta_key().alias("_k2"), *[F.col(c).alias(f"b_{c}") for c in DELTA_COLUMNS])
    both = a.join(b, F.col("_k1") == F.col("_k2"), "full_outer")
    ta, tb = F.col("a_change_type"), F.col("b_change_type")
    only_a, only_b = tb.isNull(), ta.isNull()
    conflict = (
        (ta.isin("insert", "update") & (tb == "insert"))
        | ((ta == "delete") & tb.isin("delete", "update"))
    )
    conflict = F.coalesce(conflict, F.lit(False))
    old_side = only_a | (~only_b & ta.isin("update", "delete"))
    new_side = only_b | (~only_a & tb.isin("update", "insert"))

    def pick(name: str) -> tuple[Column, Column]:
        old = F.when(old_side, F.col(f"a_old{name}")).when(only_b, F.col(f"b_old{name}"))
        new = F.when(new_side, F.col(f"b_new{name}")).when(only_a, F.col(f"a_new{name}"))
        return old, new

    old_key, new_key = pick("_key")
    old, new = pick("")
    joined = both.select(
        old_key.alias("old_key"),
        new_key.alias("new_key"),
        old.alias("old"),
        new.alias("new"),
        (F.coalesce(F.col("a_flags"), F.lit(0)).bitwiseOR(F.coalesce(F.col("b_flags"), F.lit(0)))).alias("flags"),
        conflict.alias("conflict"),
    )
    changed = F.col("conflict") | ~(
        F.col("old").eqNullSafe(F.col("new")) & F.col("old_key").eqNullSafe(F.col("new_key"))
    )
    kind = (
        F.when(F.col("conflict"), F.lit("conflict"))
        .when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.lit("update"))
        .when(F.col("new").isNotNull(), F.lit("insert"))
        .otherwise(F.lit("delete"))
    )
    return joined.filter(changed).withColumn("change_type", kind).select(*DELTA_COLUMNS, "conflict")


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """As :func:`compose`, but an impossible pair fails the job."""
    both = compose(first, second)
    checked = F.when(
        F.col("conflict"),
        F.raise_error(F.concat(F.lit("cannot concatenate deltas of key "), delta_key().cast("string"))),
    ).otherwise(F.col("change_type"))
    return both.withColumn("change_type", checked.cast("string")).select(*DELTA_COLUMNS)


def invert(delta: DataFrame) -> DataFrame:
    kind = F.col("change_type")
    swapped = F.when(kind == "insert", "delete").when(kind == "delete", "insert").otherwise(kind)
    return delta.select(
        F.col("new_key").alias("old_key"),
        F.col("old_key").alias("new_key"),
        swapped.alias("change_type"),
        F.col("new").alias("old"),
        F.col("old").alias("new"),
        "flags",
    )


def touched_keys(delta: DataFrame) -> DataFrame:
    """Every key a diff touches, old or new, once."""
    keys = F.explode(F.array_compact(F.array("old_key", "new_key")))
    return delta.select(keys.alias("key")).distinct()


def is_rename() -> Column:
    return (F.col("change_type") == "update") & (F.col("old_key") != F.col("new_key"))


def find_renames(delta: DataFrame, content: list[str]) -> DataFrame:
    """Pair deletes with inserts of equal content, at most one pair per content.

    The row of the highest key stands for its content on each side. Both come from one
    aggregate, so a content shared by a third of all rows costs no more than any other.
    The diff is read several times and therefore written once first: it is small beside
    the versions it was made from.
    """
    delta = cut(delta.select(*DELTA_COLUMNS))
    kind = F.col("change_type")
    row = F.when(kind == "delete", F.col("old")).otherwise(F.col("new"))
    parts: list[Column] = []
    for name in content:
        value = row[name]
        parts += [value.isNull(), value]
    whole = delta.filter(kind != "update").select(
        F.xxhash64(*parts).alias("_h1"),
        F.xxhash64(F.lit(7), *parts).alias("_h2"),
        F.when(kind == "delete", F.col("old_key")).alias("_d"),
        F.when(kind == "insert", F.col("new_key")).alias("_i"),
    )
    sides = whole.groupBy("_h1", "_h2").agg(F.max("_d").alias("_d"), F.max("_i").alias("_i"))
    pairs = cut(sides.filter(F.col("_d").isNotNull() & F.col("_i").isNotNull()).select("_d", "_i"))
    deletes, inserts = delta.filter(kind == "delete"), delta.filter(kind == "insert")
    renamed = (
        deletes.select(F.col("old_key").alias("_d"), "old", F.col("flags").alias("_f1"))
        .join(pairs, "_d")
        .join(inserts.select(F.col("new_key").alias("_i"), "new", F.col("flags").alias("_f2")), "_i")
        .select(
            F.col("_d").alias("old_key"),
            F.col("_i").alias("new_key"),
            F.lit("update").alias("change_type"),
            "old",
            "new",
            F.col("_f1").bitwiseOR(F.col("_f2")).alias("flags"),
        )
    )
    rest = delta.filter(kind == "update")
    left_deletes = deletes.join(pairs.select(F.col("_d").alias("old_key")), "old_key", "left_anti").select(*DELTA_COLUMNS)
    left_inserts = inserts.join(pairs.select(F.col("_i").alias("new_key")), "new_key", "left_anti").select(*DELTA_COLUMNS)
    return renamed.unionByName(rest).unionByName(left_deletes).unionByName(left_inserts)


#: Marks of the four delta halves (fixed values) and the columns that carry them.
MARKS = {"--": "minus_minus", "-": "minus", "+": "plus", "++": "plus_plus"}


def plus_minus(delta: DataFrame, wanted: set[str] | None = None, minimal: bool = False) -> DataFrame:
    """Delta halves as struct columns.

    Without ``wanted``: ``minus`` and ``plus`` (``star`` for updates when ``minimal``).
    With it: the four advanced halves, those not wanted left NULL.
    """
    old, new = F.col("old"), F.col("new")
    update = F.col("change_type") == "update"
    base = ["old_key", "new_key", "change_type"]
    if wanted is None:
        if minimal:
            return delta.select(
                *base,
                F.when(~update, old).alias("minus"),
                F.when(~update, new).alias("plus"),
                F.when(update, new).alias("star"),
            )
        return delta.select(*base, old.alias("minus"), new.alias("plus"))
    halves = {
        "--": F.when(F.col("change_type") == "delete", old),
        "-": F.when(update, old),
        "+": F.when(update, new),
        "++": F.when(F.col("change_type") == "insert", new),
    }
    return delta.select(
        *base, *[(h if m in wanted else F.when(F.lit(False), h)).alias(MARKS[m]) for m, h in halves.items()]
    )


def from_plus_minus(halves: DataFrame, key: str, flags: int = 0) -> DataFrame:
    """Delta frame from the four advanced halves."""
    old = F.coalesce("minus_minus", "minus")
    new = F.coalesce("plus_plus", "plus")
    rows = halves.select(old.alias("old"), new.alias("new"))
    kind = (
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    )
    return rows.select(
        F.col("old")[key].alias("old_key"),
        F.col("new")[key].alias("new_key"),
        kind.alias("change_type"),
        "old",
        "new",
        F.lit(flags).alias("flags"),
    )
