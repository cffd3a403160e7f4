import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry
from tidemark.plans.tilebytes import las, tiff
from tidemark.sources import geojson, tilefiles
from tidemark.streaming import jobs


def test_catalogue_of_files(spark, tmp_path):
    (tmp_path / "a.laz").write_bytes(las(3, 10.0, 20.0, 4, True))
    (tmp_path / "b.tif").write_bytes(tiff(7, 9, 100.0, 50.0, True))
    rows = {r.name: r for r in tilefiles.read(spark, str(tmp_path)).collect()}
    assert rows["a.laz"].format == "laz-1.4/copc-1.0" and rows["a.laz"].point_count == 3
    assert rows["a.laz"].native_extent == "10.0,20.0,20.0,40.0,0.0,5.0"
    assert rows["b.tif"].dimensions == "7x9" and rows["b.tif"].format == "geotiff/cog"
    assert rows["b.tif"].crs84_extent.startswith("POLYGON((100.0000000 41.0000000,100.0000000 50.0000000")


def test_geojson_files(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","id":"1","properties":{"n":5},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","id":"2","properties":{"n":null},"geometry":null}]}'
    (tmp_path / "x.geojson").write_text(doc)
    from pyspark.sql import types as T

    rows = {r.id: r for r in geojson.read(spark, str(tmp_path), T.StructType([T.StructField("n", T.LongType())])).collect()}
    assert (rows["1"].n, rows["1"].geom.minx, rows["2"].n, rows["2"].geom) == (5, 1.0, None, None)


def test_capture_over_several_runs(spark, tmp_path):
    schema = "k long, event_id long, op string, value double"
    source, target, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    for rows in ([(1, 1, "put", 1.0), (2, 2, "put", 2.0), (1, 3, "put", 3.0)], [(2, 4, "del", None), (3, 5, "put", 5.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.capture_edits(stream, "k", "event_id", target, progress)
    got = sorted((r.k, r.op, r.value) for r in jobs.captured(spark, target, "k", "event_id").collect())
    assert got == [(1, "put", 3.0), (2, "del", None), (3, "put", 5.0)]


def test_index_grows_once_per_object(spark, tmp_path):
    source, target, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    for rows in ([("a", 1.0, 2.0), ("b", 3.0, 4.0)], [("b", 3.0, 4.0), ("c", 5.0, 6.0)]):
        spark.createDataFrame(rows, "oid string, x double, y double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("oid string, x double, y double").parquet(source)
        objects = stream.select("oid", F.lit("EPSG:4326").alias("crs"), geometry.point(F.col("x"), F.col("y")).alias("geom"))
        jobs.grow_index(objects, target, progress)
    assert sorted(r.oid for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_directories_anywhere_and_large_form(spark, tmp_path):
    for i, (gap, big, order) in enumerate([(0, False, "<"), (100_000, False, "<"), (300_000, False, ">"), (70_000, True, "<"), (0, True, ">")]):
        (tmp_path / f"{i}.tif").write_bytes(tiff(7 + i, 9, 100.0, 50.0, i % 2 == 0, gap, big, order))
    rows = {r.name: r for r in tilefiles.read(spark, str(tmp_path)).collect()}
    for i in range(5):
        r = rows[f"{i}.tif"]
        assert r.dimensions == f"{7 + i}x9" and r.format == ("geotiff/cog" if i % 2 == 0 else "geotiff")
        assert r.native_extent == f"POLYGON((100.0 50.0,100.0 41.0,{107.0 + i} 41.0,{107.0 + i} 50.0,100.0 50.0))"


def test_unreadable_tile_is_named(spark, tmp_path):
    (tmp_path / "ok.tif").write_bytes(tiff(7, 9, 100.0, 50.0))
    (tmp_path / "broken.tif").write_bytes(b"II*\0" + bytes(3))
    with pytest.raises(Exception, match="broken.tif"):
        tilefiles.read(spark, str(tmp_path)).collect()
