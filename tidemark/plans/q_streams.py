"""Streams over ``events``, run until the available input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geometry
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.streaming import jobs

EDITS = "SELECT user_id AS k, max(event_id) AS event_id, CASE WHEN max(event_id) % 7 = 0 THEN 'del' ELSE 'put' END AS op, max_by(value, event_id) AS value FROM events GROUP BY user_id"


def event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("STR1", EDITS)
def str1(spark, sf):
    edits = event_stream(spark, sf).select(
        F.col("user_id").alias("k"), "event_id", F.when(F.col("event_id") % 7 == 0, "del").otherwise("put").alias("op"), "value"
    )
    target = scratch_path(spark, "edits")
    jobs.capture_edits(edits, "k", "event_id", target, scratch_path(spark, "edits-progress"))
    return jobs.captured(spark, target, "k", "event_id").select("k", "event_id", "op", "value")


@query(
    "STR2",
    """SELECT 'o' || CAST(user_id AS STRING) AS oid, CAST(user_id % 360 - 180 AS DOUBLE) AS w, CAST(user_id % 170 - 85 AS DOUBLE) AS s FROM (SELECT DISTINCT user_id FROM events) e""",
)
def str2(spark, sf):
    k = F.col("user_id")
    objects = event_stream(spark, sf).select(
        F.concat(F.lit("o"), k.cast("string")).alias("oid"), F.lit("EPSG:4326").alias("crs"), geometry.point(k % 360 - 180, k % 170 - 85).alias("geom")
    )
    target = scratch_path(spark, "index")
    jobs.grow_index(objects, target, scratch_path(spark, "index-progress"))
    return spark.read.parquet(target).select("oid", F.col("box.w").alias("w"), F.col("box.s").alias("s"))


EVERY_CHANGE = fx.ctes(
    changes=fx.CHANGES,
    before="SELECT seq, dataset, op, coalesce(lag(op) OVER (PARTITION BY dataset, key ORDER BY seq), 'del') AS was FROM changes",
)


@query(
    "STR3",
    EVERY_CHANGE
    + """SELECT seq, dataset, CAST(count(*) FILTER (op = 'put' AND was = 'del') AS BIGINT) AS inserts, CAST(count(*) FILTER (op = 'put' AND was = 'put') AS BIGINT) AS updates,
 CAST(count(*) FILTER (op = 'del') AS BIGINT) AS deletes FROM before WHERE seq % 9 <> 4 AND (op = 'put' OR was = 'put') GROUP BY 1, 2""",
)
def str3(spark, sf):
    """Counts per commit of edits that come in four files, each with edits of every commit; every ninth commit is known."""
    arrivals = scratch_path(spark, "arrivals")
    edits = fx.table(spark, sf, "events").select(
        F.expr(fx.SEQ).alias("seq"), F.col("event_type").alias("dataset"), F.col("user_id").alias("key"),
        F.when(F.col("event_id") % 7 == 0, "del").otherwise("put").alias("op"), "event_id", "ts",
    )
    for part in range(4):
        edits.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).write.parquet(f"{arrivals}/part={part}")
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 8).parquet(f"{arrivals}/part=*")
    known = edits.select("seq").distinct().filter("seq % 9 = 4")
    target = scratch_path(spark, "annotations")
    jobs.annotate_changes(stream, "ts", target, scratch_path(spark, "annotations-progress"), "3650 days", "event_id", known)
    return jobs.annotations(spark, target).drop("late")


@query("STR4", "SELECT event_type AS dataset, event_id AS key, user_id FROM events")
def str4(spark, sf):
    e = event_stream(spark, sf)
    row = F.struct("event_id", "user_id", "value")
    deltas = e.select("event_type", F.lit("insert").alias("change_type"), F.when(F.lit(False), row).alias("old"), row.alias("new"))
    target = scratch_path(spark, "lines")
    jobs.stream_lines(deltas, F.col("event_type"), target, scratch_path(spark, "lines-progress"))
    lines = spark.read.text(target)
    return lines.select(
        F.get_json_object("value", "$.dataset").alias("dataset"),
        F.get_json_object("value", "$.change.+.event_id").cast("bigint").alias("key"),
        F.get_json_object("value", "$.change.+.user_id").cast("bigint").alias("user_id"),
    )
