"""Scalar families, each over a whole column of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import envelopes, hashing, timetext
from tidemark.operators import schemas
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query


@query(
    "SCA1",
    """SELECT doc_id, substr(sha256(text), 1, 40) AS hex_hash, translate(base64(unhex(substr(sha256(text), 1, 40))), '+/', '-_') AS b64_hash,
 CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS u32 FROM documents""",
)
def sca1(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", hashing.hex_hash(text).alias("hex_hash"), hashing.base64_hash(text).alias("b64_hash"), hashing.uint32_hash(text).alias("u32")
    )


@query("SCA2", "SELECT doc_id, translate(base64(encode(text)), '+/', '-_') AS b64, hex(encode(source)) AS hex_source, text AS back FROM documents")
def sca2(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("b64", hashing.url_base64(F.encode("text", "UTF-8")))
    return docs.select("doc_id", "b64", F.hex("source").alias("hex_source"), F.decode(hashing.url_unbase64(F.col("b64")), "UTF-8").alias("back"))


@query("SCA3", "SELECT page_id, replace(replace(url, 'http://', ''), '/', '__') AS table_name, url LIKE '%.com/%' AS com FROM pages")
def sca3(spark, sf):
    from tidemark.operators.filters import dataset_matches

    bare = F.replace("url", F.lit("http://"), F.lit(""))
    return fx.table(spark, sf, "pages").select(
        "page_id", F.replace(bare, F.lit("/"), F.lit("__")).alias("table_name"), dataset_matches(F.col("url"), "*.com/*").alias("com")
    )


@query(
    "SCA4",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS back, m AS minutes,
 CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS STRING), 2, '0') || ':' || lpad(CAST(abs(m) % 60 AS STRING), 2, '0') AS tz,
 CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS STRING), 2, '0') || lpad(CAST(abs(m) % 60 AS STRING), 2, '0') AS tz_short
FROM (SELECT event_id, ts, CAST(user_id * 15 % 1680 - 840 AS INTEGER) AS m FROM events) e""",
)
def sca4(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("m", (F.col("user_id") * 15 % 1680 - 840).cast("int"))
    e = e.withColumn("iso", timetext.iso_utc(F.col("ts"))).withColumn("tz", timetext.offset_text(F.col("m")))
    return e.select(
        "event_id", "iso", timetext.from_iso_utc(F.col("iso")).cast("timestamp_ntz").alias("back"),
        timetext.offset_minutes(F.col("tz")).alias("minutes"), "tz", timetext.offset_text(F.col("m"), "").alias("tz_short"),
    )


@query(
    "SCA5",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS stored_date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stored_ts, CAST(o_custkey AS STRING) AS stored_numeric,
 o_orderkey % 2 = 1 AS stored_bool FROM orders""",
)
def sca5(spark, sf):
    o = fx.orders(spark, sf)
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"), F.lit("+00"))
    return o.select(
        "o_orderkey", timetext.stored_date(day).alias("stored_date"), timetext.stored_timestamp(stamp).alias("stored_ts"),
        timetext.stored_numeric(F.col("o_custkey"), 20, 4).alias("stored_numeric"), timetext.stored_boolean(F.col("o_orderkey") % 2).alias("stored_bool"),
    )


def wrap_sql(x: str) -> str:
    return f"(CASE WHEN ({x} + 180.0) % 360.0 < 0 THEN (({x} + 180.0) % 360.0 + 360.0) % 360.0 ELSE ({x} + 180.0) % 360.0 END - 180.0)"


@query(
    "SCA6",
    f"""SELECT c_custkey, CAST(floor((v + 180) / 360 * 1048575) AS BIGINT) AS down, CAST(ceil((v + 180) / 360 * 1048575) AS BIGINT) AS up, {wrap_sql('big')} AS wrapped, greatest(-90.0::DOUBLE, least(90.0::DOUBLE, big)) AS clamped
FROM (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS v, CAST(c_acctbal AS DOUBLE) AS big FROM customer) c""",
)
def sca6(spark, sf):
    v = (F.col("c_custkey") % 360 - 180).cast("double")
    scaled = (v + 180) / 360 * envelopes.TOP
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.floor(scaled).cast("bigint").alias("down"), F.ceil(scaled).cast("bigint").alias("up"),
        envelopes.wrap_lon(F.col("c_acctbal")).alias("wrapped"), envelopes.clamp_lat(F.col("c_acctbal")).alias("clamped"),
    )


@query(
    "SCA7",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey BETWEEN -128 AND 127 AS int8, l_partkey * 30 BETWEEN -32768 AND 32767 AS int16, l_partkey * 3000000 BETWEEN -2147483648 AND 2147483647 AS int32 FROM lineitem",
)
def sca7(spark, sf):
    k = F.col("l_partkey")
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", schemas.fits_integer(k, 8).alias("int8"), schemas.fits_integer(k * 30, 16).alias("int16"),
        schemas.fits_integer(k * 3000000, 32).alias("int32"),
    )


@query(
    "SCA8",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRUE AS is_tags, '["' || event_type || '","' || CAST(user_id AS STRING) || '"]' AS tags FROM events""",
)
def sca8(spark, sf):
    """Meta items by suffix: JSON parsed and dumped; tags are a list of text."""
    e = fx.table(spark, sf, "events")
    tags = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    parsed = F.from_json(tags, "array<string>")
    return e.select(
        "event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"), (parsed.isNotNull() & F.forall(parsed, lambda t: t.isNotNull())).alias("is_tags"), tags.alias("tags")
    )
