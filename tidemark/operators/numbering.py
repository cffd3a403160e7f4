"""Positions and running totals that never put a whole group into one task.

A window over a group runs in one task, so a group that holds a third of all rows would
make that task the job. Every function here first splits the order into buckets of bounded
size, numbers rows inside a bucket, and adds the bucket's offset from a small table of
per-bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut

#: Width of a bucket of integer keys: unique keys cannot put more rows than this into one.
KEY_STRIDE = 1 << 20

#: Hex digits of a content hash that make a bucket: 65536 buckets, so the table of
#: bucket totals has at most that many rows.
HASH_DIGITS = 4


def rank_in_group(df: DataFrame, group: list[str], key: str, name: str = "rank", stride: int = KEY_STRIDE) -> DataFrame:
    """1-based rank of a unique integer ``key`` inside ``group``, hot groups included."""
    bucket = f"_{name}_bucket"
    rows = df.withColumn(bucket, F.floor(F.col(key) / stride).cast("bigint"))
    per_bucket = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*group, bucket).orderBy(key)
    ranked = rows.withColumn("_inner", F.row_number().over(inner))
    return (
        ranked.join(offsets, [*group, bucket])
        .withColumn(name, (F.col("_offset") + F.col("_inner")).cast("bigint"))
        .drop("_offset", "_inner", bucket)
    )


def offset_before(df: DataFrame, hash_col: str, amount: str, name: str = "offset") -> DataFrame:
    """Sum of ``amount`` over all rows with a smaller ``hash_col`` (unique, uniform hex text)."""
    bucket = F.substring(F.col(hash_col), 1, HASH_DIGITS)
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.sum(amount).alias("_total"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # One task, but over at most 16 ** HASH_DIGITS rows.
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inner = W.partitionBy("_bucket").orderBy(hash_col).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(F.broadcast(bases), "_bucket")
        .withColumn(name, (F.col("_base") + F.col("_inner")).cast("bigint"))
        .drop("_bucket", "_base", "_inner")
    )


def number_all(df: DataFrame, order: list[str | Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """1-based position over the whole frame by ``order``, without a single-task sort.

    Rows are range partitioned by Spark's own sampling; the partition id is fixed by
    writing the partitioned rows to the shared folder before anything depends on it.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition.
    bases = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_inner", F.row_number().over(inner))
        .join(F.broadcast(bases), "_part")
        .withColumn(name, (F.col("_base") + F.col("_inner")).cast("bigint"))
        .drop("_part", "_base", "_inner")
    )


def expand(df: DataFrame, count: str, name: str = "copy", chunk: int = KEY_STRIDE) -> DataFrame:
    """Repeat each row ``count`` times with ``name`` running from 0.

    The repetition is done in two steps with a shuffle between, so that one row with a
    huge count becomes many tasks of at most ``chunk`` rows each.
    """
    steps = df.filter(F.col(count) > 0).withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count).cast("bigint") - 1, F.lit(chunk).cast("bigint")))
    )
    steps = steps.repartition(*df.columns, "_start")
    end = F.least(F.col("_start") + chunk, F.col(count).cast("bigint")) - 1
    return steps.withColumn(name, F.explode(F.sequence(F.col("_start"), end))).drop("_start")


def previous(df: DataFrame, group: list[str], order: str, values: list[str], stride: int = KEY_STRIDE) -> DataFrame:
    """``lag`` of ``values`` (as ``prev_<value>``) by a unique integer ``order`` inside ``group``.

    The first row of each bucket takes the last row of the nearest earlier bucket.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / stride).cast("bigint"))
    packed = F.struct(F.col(order), *[F.col(v) for v in values])
    tails = rows.groupBy(*group, "_b").agg(F.max_by(packed, F.col(order)).alias("_tail"))
    across = W.partitionBy(*group).orderBy("_b")
    tails = tails.withColumn("_from", F.lag("_tail").over(across)).drop("_tail")
    inner = W.partitionBy(*group, "_b").orderBy(order)
    out = rows.withColumn("_lag", F.lag(packed).over(inner)).join(tails, [*group, "_b"])
    prev = F.coalesce(F.col("_lag"), F.col("_from"))
    for v in values:
        out = out.withColumn(f"prev_{v}", prev[v])
    return out.drop("_lag", "_from", "_b")


def carried(df: DataFrame, order: str, values: list[str], stride: int = 1 << 16) -> DataFrame:
    """Each of ``values`` with its NULLs filled by the last value before, by a unique integer ``order``.

    Rows are looked at in stretches of ``stride``; what a stretch starts with comes from a
    table of one row per stretch.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / stride).cast("bigint"))
    tails = rows.groupBy("_b").agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_t_{v}") for v in values])
    # One task, but one row per stretch.
    across = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = tails.select("_b", *[F.last(f"_t_{v}", ignorenulls=True).over(across).alias(f"_s_{v}") for v in values])
    inner = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    met = rows.withColumns({v: F.last(v, ignorenulls=True).over(inner) for v in values}).join(starts, "_b")
    return met.withColumns({v: F.coalesce(v, f"_s_{v}") for v in values}).drop("_b", *[f"_s_{v}" for v in values])
