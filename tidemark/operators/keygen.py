"""Stable generated keys for sources that have none, and key choice.

The key map of earlier imports is a frame ``(pk, hash)``: every key ever generated with
the content id it was generated for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import KEY_STRIDE, expand, offset_before, rank_in_group


def next_generated(key_map: DataFrame, pk: str = "pk") -> DataFrame:
    return key_map.agg(F.coalesce(F.max(pk) + 1, F.lit(1)).cast("bigint").alias("next_pk"))


def distinct_contents(rows: DataFrame, content: Column) -> DataFrame:
    """Each content once, with the number of rows that have it (``copies``).

    Copies are counted, never gathered: a content held by a third of all rows becomes
    one partial count per task.
    """
    hashed = rows.withColumn("hash", content)
    counts = hashed.groupBy("hash", *rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    return counts


def assign_keys(
    rows: DataFrame, key_map: DataFrame, content: Column, pk: str = "auto_pk", stride: int = KEY_STRIDE
) -> DataFrame:
    """Rows with a key each: an unused earlier key of the same content, else a new one.

    Earlier keys of a content are used in ascending order; new keys start above every key
    ever generated and run in the order of content ids.
    """
    contents = distinct_contents(rows, content)
    slim = contents.select("hash", "copies")
    ranked = rank_in_group(key_map.select("hash", F.col("pk").cast("bigint").alias("pk")), ["hash"], "pk", "rank")
    reused = (
        ranked.withColumn("_chunk", _chunk_of(F.col("rank") - 1, stride))
        .join(_in_chunks(slim, stride), ["hash", "_chunk"])
        .filter(F.col("rank") <= F.col("copies"))
        .select("hash", "_chunk", F.col("pk").alias(pk))
    )
    known = key_map.groupBy("hash").agg(F.count(F.lit(1)).alias("known"))
    extra = (
        slim.join(known, "hash", "left")
        .select("hash", F.coalesce("known", F.lit(0)).alias("known"), (F.col("copies") - F.coalesce("known", F.lit(0))).alias("extra"))
        .filter(F.col("extra") > 0)
    )
    placed = offset_before(extra, "hash", "extra", "_offset").withColumn("next_pk", next_generated(key_map).scalar())
    fresh = expand(placed, "extra", "_copy", stride).select(
        "hash",
        _chunk_of(F.col("known") + F.col("_copy"), stride).alias("_chunk"),
        (F.col("next_pk") + F.col("_offset") + F.col("_copy")).cast("bigint").alias(pk),
    )
    keys = reused.unionByName(fresh)
    return keys.join(_in_chunks(contents, stride), ["hash", "_chunk"]).select(pk, *rows.columns, "hash")


def _chunk_of(index: Column, stride: int) -> Column:
    return F.floor(index / stride).cast("bigint")


def _in_chunks(contents: DataFrame, stride: int) -> DataFrame:
    """A content once per ``stride`` of its copies.

    Keys meet their content on (hash, chunk), so that no join key stands for more than
    ``stride`` rows, however many copies one content has.
    """
    last = _chunk_of(F.col("copies") - 1, stride)
    return contents.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def updated_map(keyed: DataFrame, key_map: DataFrame, pk: str = "auto_pk") -> DataFrame:
    """Every key ever generated, with the content of its latest row."""
    now = keyed.select(F.col(pk).alias("pk"), "hash")
    return now.unionByName(key_map.join(now, "pk", "left_anti").select("pk", "hash"))


def leave_one_out(rows: DataFrame, key: str, columns: dict[str, str], side: str) -> DataFrame:
    """Hashes of a row as a whole and without each single field: ``side_key, h1, h2``.

    ``columns`` maps column id to column name. A field's hash carries its column id, and
    a row's hash is the XOR of its fields', so a row that lacks a column altogether can
    meet the leave-one-out hash of a row that has it.
    """
    def field(cid: str, name: str, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(cid), F.col(name).isNull(), F.col(name))

    def xor(values: list[Column]) -> Column:
        return reduce(lambda a, b: a.bitwiseXOR(b), values, F.lit(0).cast("bigint"))

    # Plain columns, not arrays with lambdas: the whole of it stays in generated code.
    ones = [f"_a{i}" for i in range(len(columns))]
    twos = [f"_b{i}" for i in range(len(columns))]
    pieces = rows.select(
        F.col(key).alias(f"{side}_key"),
        *[field(cid, name, 11).alias(p) for p, (cid, name) in zip(ones, columns.items())],
        *[field(cid, name, 13).alias(p) for p, (cid, name) in zip(twos, columns.items())],
    )
    whole = pieces.withColumn("_w1", xor([F.col(p) for p in ones])).withColumn("_w2", xor([F.col(p) for p in twos]))
    variants = [F.struct(F.col("_w1").alias("h1"), F.col("_w2").alias("h2"))] + [
        F.struct(F.col("_w1").bitwiseXOR(F.col(p)).alias("h1"), F.col("_w2").bitwiseXOR(F.col(q)).alias("h2"))
        for p, q in zip(ones, twos)
    ]
    return whole.select(f"{side}_key", F.explode(F.array(*variants)).alias("_v")).select(f"{side}_key", "_v.h1", "_v.h2")


def similar_pairs(
    deleted: DataFrame,
    inserted: DataFrame,
    old_key: str,
    new_key: str,
    old_columns: dict[str, str],
    new_columns: dict[str, str],
) -> DataFrame:
    """Pairs ``(old_key, new_key)`` of rows that differ in at most one field, unique both ways.

    A hash counts only when exactly one row of each side has it; that is a count and a
    minimum per hash, so popular hashes are never spelled out as pairs. The rows then
    must agree on one partner each.
    """
    old = leave_one_out(deleted, old_key, old_columns, "old").withColumn("new_key", F.lit(None).cast(dict(inserted.dtypes)[new_key]))
    new = leave_one_out(inserted, new_key, new_columns, "new").withColumn("old_key", F.lit(None).cast(dict(deleted.dtypes)[old_key]))
    both = old.unionByName(new)
    buckets = both.groupBy("h1", "h2").agg(
        F.count("old_key").alias("n_old"),
        F.count("new_key").alias("n_new"),
        F.min("old_key").alias("old_key"),
        F.min("new_key").alias("new_key"),
    )
    meets = buckets.filter("n_old = 1 AND n_new = 1").select("old_key", "new_key")
    by_old = meets.groupBy("old_key").agg(F.min("new_key").alias("new_key"), F.max("new_key").alias("_last"))
    by_old = by_old.filter(F.col("new_key") == F.col("_last")).select("old_key", "new_key")
    by_new = meets.groupBy("new_key").agg(F.min("old_key").alias("old_key"), F.max("old_key").alias("_last"))
    by_new = by_new.filter(F.col("old_key") == F.col("_last")).select("old_key", "new_key")
    return by_old.join(by_new, ["old_key", "new_key"])


def rekey_similar(keyed: DataFrame, pairs: DataFrame, pk: str = "auto_pk") -> DataFrame:
    """Newly keyed rows take the key of the deleted row they are similar to."""
    p = pairs.select(F.col("new_key").alias(pk), F.col("old_key").alias("_old"))
    joined = keyed.join(p, pk, "left")
    return joined.withColumn(pk, F.coalesce("_old", pk)).select(*keyed.columns)


def similarity_allowed(inserted_columns: int, dropped_columns: int, rekeyed: int) -> bool:
    return rekeyed == 0 and inserted_columns <= 1 and dropped_columns <= 1


def usable_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each candidate column: is it free of NULLs and unique.

    Columns are stacked and counted per value before values are counted, so a value held
    by most rows is one partial count per task.
    """
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")
    ).select("s.column", "s.value")
    per_value = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("value").isNotNull().cast("bigint")).alias("n_distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    ).withColumn("usable", (F.col("n_null") == 0) & (F.col("n_rows") == F.col("n_distinct")))


def replace_ids(base: DataFrame, source: DataFrame, ids: DataFrame, pk: str) -> DataFrame:
    """Only listed keys are replaced; a listed key the source lacks is deleted."""
    wanted = ids.select(pk).distinct()
    return base.join(wanted, pk, "left_anti").unionByName(source.join(wanted, pk, "left_semi").select(*base.columns))


def kept_rows(imported: DataFrame, replaced: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    """For each imported key: was the old row, seen through the shared columns, the same."""
    a = imported.select(pk, F.struct(*columns).alias("_new"))
    b = replaced.select(pk, F.struct(*columns).alias("_old"))
    return a.join(b, pk, "left").select(pk, F.col("_old").eqNullSafe(F.col("_new")).alias("kept"))
