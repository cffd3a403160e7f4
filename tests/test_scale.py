"""What a query costs as its tables grow: tasks, repeated work, batches."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import crs, envelopes
from tidemark.plans import tilebytes
from tidemark.sources import tilefiles


@pytest.fixture
def customers(spark, tmp_path):
    """A folder whose customer table is one file of one row group."""
    rows = spark.range(200).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"))
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_one_row_group_is_many_tasks(spark, customers):
    boxes = entry.queries()["GEO13_TM"](spark, customers)
    assert boxes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert boxes.filter("covers AND narrow AND problem IS NULL").count() == 200


def test_projection_names_each_function_once(spark):
    x, y = F.col("x"), F.col("y")
    frame = spark.createDataFrame([(1600000.0 + k * 70000, 5400000.0 - k * 90000) for k in range(-9, 10)] + [(None, 1.0)], "x double, y double")
    boxes = frame.select(envelopes.project_box("EPSG:2193", x, y, x + 1000, y + 1000).alias("b"))
    plan = boxes._jdf.queryExecution().analyzed().toString().lower()
    # Once for the coarse border and once for the fine one.
    assert (plan.count("asin("), plan.count("atan2(")) == (2, 2)
    lon, lat = crs.to_lonlat("EPSG:2193", x, y)
    assert frame.filter(~crs.lonlat_point("EPSG:2193", x, y).eqNullSafe(F.struct(lon.alias("x"), lat.alias("y")))).count() == 0


@pytest.mark.parametrize("name", ["GEO1", "GEO3", "GEO4"])
def test_shapes_go_through_python_in_many_tasks(spark, customers, name):
    out = entry.queries()[name](spark, customers)
    partitions = out.rdd.getNumPartitions()
    assert partitions >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    rows = out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(rows) == 200 and max(rows) <= 100


@pytest.fixture
def parts(spark, tmp_path):
    """A folder whose part table is one file of one row group."""
    spark.range(200).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_tiles_are_read_in_many_tasks(spark, parts):
    rows = entry.queries()["SRC14"](spark, parts)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(r.name for r in rows.collect()) == sorted(f"t{k}.{'tif' if k % 5 == 4 else 'laz'}" for k in range(200))


def test_tile_is_made_once_and_waits_for_nothing(spark, parts):
    plan = entry.queries()["SRC14"](spark, parts)._jdf.queryExecution().executedPlan().toString()
    # One pass makes the files, one reads their headers; neither is an expression that keeps its row waiting or comes twice.
    assert (plan.count("MapInArrow "), plan.count("ArrowEvalPython")) == (2, 0)


def test_content_is_asked_for_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    small = tilebytes.las(3, 1.0, 2.0)

    @F.arrow_udf("binary")
    def content(ids: pa.Array) -> pa.Array:
        for k in ids.to_pylist():
            with open(calls / str(k), "a") as out:
                out.write("x")
        return pa.array([small] * len(ids), pa.binary())

    files = spark.range(20).select(F.concat(F.lit("a/"), "id").alias("path"), content("id").alias("content"))
    assert {r.format for r in tilefiles.catalogue(files).collect()} == {"laz-1.4"}
    assert [p.read_text() for p in calls.iterdir()] == ["x"] * 20


def test_batches_of_files_are_bounded_in_bytes():
    k = [20 * i + 9 for i in range(300)] + list(range(300))
    batch = pa.RecordBatch.from_pydict({"k": k, "path": [f"t{v}" for v in k], "x": [1.0] * 600, "y": [2.0] * 600})
    made = list(tilebytes._made(iter([batch, batch.slice(0, 0)])))
    assert len(made) > 5 and max(b.nbytes for b in made) < tilebytes.BATCH_BYTES + 200_000
    assert [r for b in made for r in b.to_pylist()] == [{"k": v, "path": f"t{v}", "content": tilebytes.tile_of(v, 1.0, 2.0)} for v in k]


def test_large_files_send_few_bytes_to_python(spark):
    whole = {
        "late.tif": tilebytes.tiff(7, 9, 100.0, 50.0, True, 300_000),
        "big.tif": tilebytes.tiff(7, 9, 100.0, 50.0, True, 300_000, True, ">"),
        "cloud.laz": tilebytes.las(3, 1.0, 2.0, 4, True) + bytes(300_000),
    }
    files = spark.createDataFrame([(f"a/{n}", bytearray(c)) for n, c in whole.items()], "path string, content binary")
    assert all(len(r.head) + len(r.directory or b"") + len(r.scale or b"") + len(r.tie or b"") < 600 for r in tilefiles.pieces(files).collect())
    rows = {r.name: r for r in tilefiles.catalogue(files).collect()}
    for name, content in whole.items():
        assert (rows[name].oid, rows[name].size) == ("sha256:" + hashlib.sha256(content).hexdigest(), len(content))
    assert [rows[n].format for n in whole] == ["geotiff/cog", "geotiff/cog", "laz-1.4/copc-1.0"]
    assert rows["late.tif"].native_extent == rows["big.tif"].native_extent == "POLYGON((100.0 50.0,100.0 41.0,107.0 41.0,107.0 50.0,100.0 50.0))"


def test_values_outside_a_file_name_it(spark):
    cut_off = tilebytes.tiff(7, 9, 100.0, 50.0)[:-20]
    files = spark.createDataFrame([("a/short.tif", bytearray(cut_off))], "path string, content binary")
    with pytest.raises(Exception, match="not a readable tile file: a/short.tif"):
        tilefiles.catalogue(files).collect()
