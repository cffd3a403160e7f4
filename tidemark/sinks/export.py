"""Export of a dataset version to files of another form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geometry, wkb
from tidemark.operators.spatial import has_shape, reproject

FORMATS = ("parquet", "orc", "csv", "json", "geojson")


def export(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    *,
    geom: str | None = None,
    pk: str | None = None,
    pk_as_field: bool = True,
    source_crs: str | None = None,
    target_crs: str | None = None,
    geometry_type: str | None = None,
    drop_null: bool = False,
    drop_empty: bool = False,
    drop_geometry: bool = False,
    overwrite: bool = False,
) -> None:
    """Write rows as files; geometry as WKB, as hex WKB in text formats, or as GeoJSON lines.

    ``geometry_type`` overrides the kind, where a single kind may become its multi kind.
    """
    if fmt not in FORMATS:
        raise ValueError(f"no such export format: {fmt}")
    out = df
    if geom and (drop_null or drop_empty):
        g = F.col(geom)
        out = out.filter(has_shape(g) if drop_empty and drop_null else (g.isNotNull() if drop_null else g.isNull() | ~g["empty"]))
    if geom and target_crs and source_crs and target_crs != source_crs:
        out = out.withColumn(geom, reproject(F.col(geom), source_crs, target_crs, F.col(pk) if pk else F.lit("")))
    if geom and geometry_type and geometry_type.startswith("MULTI"):
        out = out.withColumn(geom, geometry.promote(F.col(geom)))
    mode = "overwrite" if overwrite else "errorifexists"
    if fmt == "geojson":
        from tidemark.sinks.render import rows_geojson

        rows_geojson(out, pk).select("feature").write.mode(mode).text(path)
        return
    if geom and drop_geometry:
        out = out.drop(geom)
    elif geom:
        shape = wkb.to_wkb(F.col(geom)) if fmt in ("parquet", "orc") else wkb.to_hex_wkb(F.col(geom))
        out = out.withColumn(geom, shape)
    if pk and not pk_as_field:
        out = out.drop(pk)
    writer = out.write.mode(mode)
    (writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path))
