"""Scans of stored versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import VersionedSchema


def scan(stored: Sequence[DataFrame] | DataFrame, schema: VersionedSchema) -> DataFrame:
    """Rows written under any number of earlier schemas, as the current one sees them."""
    parts = [stored] if isinstance(stored, DataFrame) else list(stored)
    out = schema.read(parts[0])
    for p in parts[1:]:
        out = out.unionByName(schema.read(p))
    return out


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def version_at(versions: DataFrame, seq) -> DataFrame:
    """The version of every dataset in force at ``seq``: one row per path."""
    latest = versions.filter(F.col("seq") <= seq).groupBy("path").agg(
        F.max(F.struct("seq", *[c for c in versions.columns if c not in ("path", "seq")])).alias("_v")
    )
    return latest.select("path", "_v.*")
