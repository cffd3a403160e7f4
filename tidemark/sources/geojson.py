"""GeoJSON feature collections to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geometry import from_geojson


def features(docs: DataFrame, properties: T.StructType, text: str = "doc", geom: str = "geom") -> DataFrame:
    """Rows of feature collections (or single features), one document per input row."""
    listed = F.from_json(F.get_json_object(text, "$.features"), "array<string>")
    one = F.array(F.col(text))
    each = docs.select(F.explode(F.coalesce(listed, one)).alias("_f"))
    return each.select(
        F.get_json_object("_f", "$.id").alias("id"),
        F.from_json(F.get_json_object("_f", "$.properties"), properties).alias("_p"),
        from_geojson(F.get_json_object("_f", "$.geometry")).alias(geom),
    ).select("id", "_p.*", geom)


def read(spark: SparkSession, path: str, properties: T.StructType, lines: bool = False) -> DataFrame:
    """Feature collection files, or with ``lines`` one feature per line, which splits over tasks."""
    docs = spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "doc")
    return features(docs, properties)
