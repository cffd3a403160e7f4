"""Counts, estimates and summaries of diffs, conflicts and metadata."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import fingerprint
from tidemark.operators.diffing import key_of

#: Sampled subtrees per accuracy level (fixed values).
ACCURACY = {"veryfast": 2, "fast": 16, "medium": 32, "good": 64}


def type_counts(delta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per change type; types that do not occur are absent."""
    return delta.groupBy(*by, "change_type").agg(F.count(F.lit(1)).alias("n"))


def type_count_columns(delta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = [
        F.sum((F.col("change_type") == kind).cast("bigint")).alias(name)
        for kind, name in (("insert", "inserts"), ("update", "updates"), ("delete", "deletes"))
    ]
    return delta.groupBy(*by).agg(*sums) if by else delta.agg(*sums)


def invert_counts(counts: DataFrame) -> DataFrame:
    """Counts of the opposite direction: inserts and deletes trade places."""
    return counts.withColumnsRenamed({"inserts": "_d", "deletes": "inserts"}).withColumnRenamed("_d", "deletes")


def status_counts(delta: DataFrame, clash: Column, by: Sequence[str] = ()) -> DataFrame:
    """Workspace counts, with key reuse outside the filter taken out of the updates."""
    kind = F.col("change_type")
    sums = [
        F.sum((kind == "insert").cast("bigint")).alias("inserts"),
        F.sum(((kind == "update") & ~clash).cast("bigint")).alias("updates"),
        F.sum((kind == "delete").cast("bigint")).alias("deletes"),
        F.sum(((kind == "update") & clash).cast("bigint")).alias("spatial_filter_conflicts"),
    ]
    return delta.groupBy(*by).agg(*sums) if by else delta.agg(*sums)


def bucket_of(pk: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(key_of(pk)), F.lit(buckets)).cast("int")


def bucket_sums(df: DataFrame, pk: Sequence[str], buckets: int) -> DataFrame:
    """Row count and order-free checksum per key bucket; at most ``buckets`` rows.

    This is the table a version keeps beside its data: two versions are compared by
    joining two such tables, and only buckets that differ need their rows read.
    """
    h1, h2 = fingerprint([*pk, *[c for c in df.columns if c not in pk]])
    rows = df.select(bucket_of(pk, buckets).alias("bucket"), h1.alias("_h1"), h2.alias("_h2"))
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("_h1").alias("x1"), F.bit_xor("_h2").alias("x2")
    )


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    old = a.select("bucket", F.struct("n", "x1", "x2").alias("_a"))
    new = b.select("bucket", F.struct("n", "x1", "x2").alias("_b"))
    return old.join(new, "bucket", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket")


def estimate_changed(old: DataFrame, new: DataFrame, pk: Sequence[str], accuracy: str = "fast", buckets: int = 4096) -> DataFrame:
    """Estimated number of changed rows from a few differing key buckets.

    Buckets that differ are found from checksums. The first ``ACCURACY`` of them (in the
    order of a fixed hash) are compared row by row and the count is scaled up. When no
    more buckets differ than are sampled, the result is exact.
    """
    from tidemark.operators.diffing import changed_keys

    take = ACCURACY[accuracy]
    differing = differing_buckets(bucket_sums(old, pk, buckets), bucket_sums(new, pk, buckets))
    # At most `buckets` rows on either side of these joins, so broadcasting them is bounded.
    total = differing.agg(F.count(F.lit(1)).alias("differing"))
    sample = differing.orderBy(F.xxhash64("bucket", F.lit(0)), "bucket").limit(take)
    sampled_old = old.withColumn("bucket", bucket_of(pk, buckets)).join(F.broadcast(sample), "bucket", "left_semi").drop("bucket")
    sampled_new = new.withColumn("bucket", bucket_of(pk, buckets)).join(F.broadcast(sample), "bucket", "left_semi").drop("bucket")
    changed = changed_keys(sampled_old, sampled_new, pk).agg(F.count(F.lit(1)).alias("changed"))
    scaled = F.when(F.col("differing") <= take, F.col("changed")).otherwise(
        F.round(F.col("changed") * F.col("differing") / F.lit(take)).cast("bigint")
    )
    return total.withColumn("_one", F.lit(1)).join(changed.withColumn("_one", F.lit(1)), "_one").select(
        scaled.alias("estimate"), "differing", (F.col("differing") <= take).alias("exact")
    )


def occupancy_estimate(distinct: int, slots: int) -> float:
    """Expected number of items when ``distinct`` of ``slots`` hold at least one."""
    return math.log(1 - distinct / slots) / math.log(1 - 1 / slots)


def conflict_keys(conflicts: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Level 1 of a conflict summary: one row per conflicting key, filed under ``by``."""
    return conflicts.select(*by, key).distinct()


def conflict_counts(conflicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Level 2 of a conflict summary: the number of conflicts."""
    return conflicts.groupBy(*by).agg(F.count(F.lit(1)).alias("conflicts"))


def next_key(df: DataFrame, pk: str, default: int = 0) -> DataFrame:
    """The first key of the free range above all rows."""
    return df.agg(F.coalesce(F.max(pk) + 1, F.lit(default)).cast("bigint").alias("next_key"))


def merge_metadata(items: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """One value per meta item, or a conflict between its distinct values.

    ``values`` holds the distinct values of an item in order. Values are made distinct
    before they are gathered, so its size follows the number of different documents
    (formats, schemas, reference systems), not the number of tiles.
    """
    distinct = items.filter(F.col(value).isNotNull()).select(*by, item, value).distinct()
    return distinct.groupBy(*by, item).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.min(value).alias("value"),
    ).withColumn("conflict", F.col("n_values") > 1)


def conflicting_values(items: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """The distinct values of every item that has more than one, one row each."""
    distinct = items.filter(F.col(value).isNotNull()).select(*by, item, value).distinct()
    many = distinct.groupBy(*by, item).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return distinct.join(many, [*by, item], "left_semi")


def merge_labels(labels: DataFrame, by: Sequence[str], number: str, label: str) -> DataFrame:
    """Union of number-to-label maps; a number with two labels is a conflict."""
    return labels.filter(F.col(label).isNotNull()).groupBy(*by, number).agg(
        F.min(label).alias("label"), (F.min(label) != F.max(label)).alias("conflict")
    )
