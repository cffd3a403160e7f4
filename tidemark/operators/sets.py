"""Set operations over paths, trees and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_paths(a: DataFrame, b: DataFrame, column: str = "path") -> DataFrame:
    return a.select(column).unionByName(b.select(column)).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of one side only, with the side they are on."""
    left = a.select(*columns).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    right = b.select(*columns).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    sums = left.unionByName(right).groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return sums.filter(F.col("_a") != F.col("_b")).select(*columns, F.when(F.col("_a") > 0, "old").otherwise("new").alias("side"))


def row_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, copies counted: ``side, n`` and the row.

    A signed count per row instead of two ``EXCEPT ALL``: one shuffle, and copies of a
    popular row are added up before it.
    """
    left = a.withColumn("_w", F.lit(1).cast("bigint"))
    right = b.select(*a.columns).withColumn("_w", F.lit(-1).cast("bigint"))
    net = left.unionByName(right).groupBy(*a.columns).agg(F.sum("_w").alias("_net")).filter("_net <> 0")
    return net.select(
        *a.columns, F.when(F.col("_net") > 0, "base").otherwise("workspace").alias("side"), F.abs("_net").alias("n")
    )


def untracked(tables: DataFrame, datasets: DataFrame, column: str = "name") -> DataFrame:
    return tables.join(datasets.select(column), column, "left_anti")
