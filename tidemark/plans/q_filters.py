"""Scans and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diffing, filters, snapshots, spatial
from tidemark.plans import fixtures as fx
from tidemark.plans.q_diff import COLS, PK, WITH_DIFF, columns, edit_diff
from tidemark.plans.registry import query
from tidemark.schema import ColumnSpec, VersionedSchema

# -- scans ----------------------------------------------------------------------------

CUSTOMER_V1 = {"k1": ("c_custkey", "integer"), "k2": ("c_name", "text"), "k3": ("c_nationkey", "integer"), "k4": ("c_acctbal", "float")}
CUSTOMER_V2 = VersionedSchema(
    (
        ColumnSpec("k4", "balance", "float"),
        ColumnSpec("k1", "c_custkey", "integer", 0),
        ColumnSpec("k2", "full_name", "text"),
        ColumnSpec("k5", "segment", "text"),
    )
)


def stored_customers(spark, sf):
    """Rows written before and after a rename, a move, a drop and an added column."""
    c = fx.table(spark, sf, "customer")
    old = c.filter("c_custkey % 2 = 0").select(*[F.col(n).alias(i) for i, (n, _) in CUSTOMER_V1.items()])
    new = c.filter("c_custkey % 2 = 1").select(
        F.col("c_custkey").alias("k1"), F.col("c_name").alias("k2"), F.col("c_acctbal").alias("k4"), F.col("c_mktsegment").alias("k5")
    )
    return [old, new]


EVOLVED = """SELECT c_acctbal AS balance, c_custkey, c_name AS full_name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer"""


@query("SRC1", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def src1(spark, sf):
    schema = VersionedSchema.infer(fx.orders(spark, sf), PK, "orders")
    return snapshots.scan(schema.to_storage(fx.orders(spark, sf)), schema)


@query("SRC2", "SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def src2(spark, sf):
    keys = fx.table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.lookup(fx.orders(spark, sf), keys, "o_orderkey")


@query("SRC2_MISSING", "SELECT DISTINCT l_partkey * 3 AS p_partkey FROM lineitem WHERE l_partkey * 3 NOT IN (SELECT p_partkey FROM part)")
def src2_missing(spark, sf):
    keys = fx.table(spark, sf, "lineitem").select((F.col("l_partkey") * 3).alias("p_partkey"))
    return filters.missing_keys(fx.table(spark, sf, "part"), keys, "p_partkey")


@query("SRC3", "SELECT * FROM orders WHERE o_orderkey % 7 IN (1, 2)")
def src3(spark, sf):
    return fx.orders(spark, sf).filter(F.pmod("o_orderkey", F.lit(7)).isin(1, 2))


@query("SRC5", EVOLVED)
def src5(spark, sf):
    return snapshots.scan(stored_customers(spark, sf), CUSTOMER_V2)


@query("FLT21", "SELECT balance, c_custkey FROM (" + EVOLVED + ") v")
def flt21(spark, sf):
    narrow = VersionedSchema(CUSTOMER_V2.columns[:2])
    return snapshots.scan(stored_customers(spark, sf), narrow)


@query("SRC6", "SELECT 'orders' AS dataset, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'tiles' AS dataset, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 4 <> 0")
def src6(spark, sf):
    from tidemark.operators.tiles import without_sidecars

    names = fx.table(spark, sf, "part").select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, F.lit(".tif.aux.xml")).otherwise(F.lit(".tif"))).alias("name")
    )
    rows = snapshots.row_count(fx.orders(spark, sf)).withColumn("dataset", F.lit("orders"))
    tiles = snapshots.row_count(without_sidecars(names)).withColumn("dataset", F.lit("tiles"))
    return rows.unionByName(tiles).select("dataset", "n")


@query("SRC10", "SELECT c.* FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def src10(spark, sf):
    ids = fx.orders(spark, sf).filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.lookup(fx.table(spark, sf, "customer"), ids, "c_custkey")


# -- item filters ---------------------------------------------------------------------

ITEMS = """SELECT event_type AS dataset, CASE WHEN event_id % 10 = 0 THEN 'meta' ELSE 'feature' END AS part,
 CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 20 = 0 THEN 'title' ELSE 'schema.json' END ELSE CAST(user_id AS STRING) END AS key, event_id FROM events"""


@query(
    "FLT1",
    fx.ctes(items=ITEMS)
    + """SELECT * FROM items WHERE dataset = 'click' OR (dataset = 'error' AND part = 'feature' AND key IN ('3', '8', '12'))
 OR (dataset = 'view' AND part = 'meta' AND key = 'title') OR (dataset = 'purchase' AND part = 'meta')""",
)
def flt1(spark, sf):
    wanted = ["click", "error:3", "error:feature:8", "error:12", "view:meta:title", "purchase:meta"]
    return fx.derive(spark, sf, ITEMS).filter(filters.matches_patterns(wanted, F.col("dataset"), F.col("part"), F.col("key")))


@query("FLT2", "SELECT doc_id, lang || '/' || source AS dataset FROM documents WHERE (lang || '/' || source) LIKE 'f%/src%' OR (lang || '/' || source) LIKE '%1'")
def flt2(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("dataset"))
    name = F.col("dataset")
    return docs.filter(filters.dataset_matches(name, "f*/src*") | filters.dataset_matches(name, "*1"))


@query("FLT3", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE CAST(l_orderkey AS STRING) || ',' || CAST(l_linenumber AS STRING) IN ('1,1', '7,3', '5979,6', '100,2', '2500,4')")
def flt3(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    wanted = diffing.key_text(["l_orderkey", "l_linenumber"]).isin("1,1", "7,3", "5979,6", "100,2", "2500,4")
    return lines.filter(wanted).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("FLT4", fx.ctes(items=ITEMS) + "SELECT * FROM items WHERE dataset NOT IN ('click', 'view')")
def flt4(spark, sf):
    return filters.exclude_datasets(fx.derive(spark, sf, ITEMS), ["click", "view"])


@query(
    "FLT6",
    WITH_DIFF + "SELECT old_key, new_key, change_type FROM diff WHERE old_key IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) OR new_key IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)",
)
def flt6(spark, sf):
    keys = fx.table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("key"))
    return filters.deltas_at(edit_diff(spark, sf), keys).select("old_key", "new_key", "change_type")


@query("FLT7", WITH_DIFF + f"SELECT old_key, new_key, change_type, {columns('old_')}, {columns('new_')} FROM diff WHERE coalesce(old_key, new_key) IN (3, 5, 7, 20000013, 9, 10000011)")
def flt7(spark, sf):
    keys = ["3", "5", 7, "20000013", "9", 10000011, "not-a-number"]
    return fx.flat(diffing.diff_at_keys(fx.orders(spark, sf), fx.edited(spark, sf), PK, keys), COLS)


@query("FLT8", "SELECT doc_id, TRY_CAST(replace(source, 'src', '') AS BIGINT) AS as_integer, TRY_CAST(lang AS BIGINT) AS bad FROM documents")
def flt8(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        filters.coerce_key(F.replace("source", F.lit("src"), F.lit("")), "bigint").alias("as_integer"),
        filters.coerce_key(F.col("lang"), "bigint").alias("bad"),
    )


FOLDERS = ["fr/src0", "en/src1", "de"]


@query(
    "FLT9",
    "SELECT * FROM (SELECT doc_id, lang || '/' || source || '/' || CAST(doc_id AS STRING) AS path FROM documents) d WHERE "
    + " OR ".join(f"path = '{f}' OR path LIKE '{f}/%'" for f in FOLDERS),
)
def flt9(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    return docs.filter(filters.path_selected(F.col("path"), FOLDERS))


@query("FLT10", fx.ctes(items=ITEMS) + "SELECT dataset, key, event_id FROM items WHERE part = 'meta' AND key IN ('title', 'description')")
def flt10(spark, sf):
    items = fx.derive(spark, sf, ITEMS).filter("part = 'meta'")
    return items.filter(filters.meta_selected(F.col("key"), ["title", "description"])).select("dataset", "key", "event_id")


@query(
    "FLT11",
    fx.ctes(commits=fx.COMMITS)
    + """SELECT seq, commit_id, author, message, commit_time FROM commits WHERE commit_time >= TIMESTAMP '2024-01-05' AND commit_time <= TIMESTAMP '2024-01-28'
 AND regexp_matches(author, 'author[01]') AND regexp_matches(message, '^Edit of')""",
)
def flt11(spark, sf):
    found = filters.filter_commits(
        fx.commits(spark, sf), since="2024-01-05", until="2024-01-28", author="author[01]", message="^Edit of"
    )
    return found.select("seq", "commit_id", "author", "message", "commit_time")


@query(
    "FLT22",
    """SELECT p_partkey AS id, p_type AS item FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO')
UNION ALL SELECT p_partkey AS id, 'crs/' || p_brand AS item FROM part WHERE p_partkey % 3 <> 0""",
)
def flt22(spark, sf):
    part = fx.table(spark, sf, "part")
    meta = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("item"), F.lit(False).alias("builtin")).unionByName(
        part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("crs/"), "p_brand").alias("item"), (F.col("p_partkey") % 3 == 0).alias("builtin"))
    )
    capable = part.filter(F.col("p_type").isin("ECONOMY", "SMALL", "PROMO")).select(F.col("p_type").alias("item"))
    return filters.supported_meta(meta, capable).select("id", "item")


# -- spatial filters ------------------------------------------------------------------

#: A concave polygon in degrees.
AREA = [(-100.5, -40.5), (60.5, -40.5), (60.5, 50.5), (-20.0, 10.0), (-100.5, 50.5), (-100.5, -40.5)]


def ray_sql(x: str, y: str) -> str:
    """Even-odd test of a point against ``AREA``, written out edge by edge."""
    terms = []
    for (x1, y1), (x2, y2) in zip(AREA, AREA[1:]):
        if y1 != y2:
            terms.append(
                f"CASE WHEN (({y1} > {y}) <> ({y2} > {y})) AND {x} < ({x2} - ({x1})) * ({y} - ({y1})) / ({y2} - ({y1})) + ({x1}) THEN 1 ELSE 0 END"
            )
    return "(" + " + ".join(terms) + ") % 2 = 1"


IN_AREA = ray_sql("x", "y")


@query("FLT12", fx.ctes(p=fx.POINTS) + f"SELECT fid, x, y FROM p WHERE fid % 10 = 0 OR {IN_AREA}")
def flt12(spark, sf):
    """Rows without a geometry match every filter."""
    pts = fx.points(spark, sf)
    shape = F.when(F.col("fid") % 10 != 0, spatial.point(F.col("x"), F.col("y")))
    area = spatial.Area([[AREA]])
    return pts.withColumn("geom", shape).filter(area.matches(F.col("geom"))).select("fid", "x", "y")


@query(
    "FLT13",
    """SELECT c_custkey, CASE WHEN bx1 < 0 THEN bx2 > 0 WHEN 0 < bx1 THEN 50 > bx1 ELSE bx2 <> bx1 END AND CASE WHEN by1 < 0 THEN by2 > 0 WHEN 0 < by1 THEN 50 > by1 ELSE by2 <> by1 END AS overlaps
FROM (SELECT c_custkey, c_custkey % 120 - 60 AS bx1, c_custkey % 120 - 60 + c_custkey % 7 AS bx2, c_custkey % 90 - 45 AS by1, c_custkey % 90 - 45 + c_custkey % 5 AS by2 FROM customer) b""",
)
def flt13(spark, sf):
    k = F.col("c_custkey")
    box = spatial.box(k % 120 - 60, k % 90 - 45, k % 120 - 60 + k % 7, k % 90 - 45 + k % 5)
    fixed = spatial.box(F.lit(0), F.lit(0), F.lit(50), F.lit(50))
    return fx.table(spark, sf, "customer").select("c_custkey", spatial.boxes_overlap(fixed, box).alias("overlaps"))


@query(
    "FLT14",
    fx.ctes(p=fx.POINTS)
    + f"""SELECT fid, CASE WHEN fid % 10 = 1 THEN 'NONEXISTENT' WHEN fid % 10 = 0 OR {IN_AREA} THEN 'MATCHING' ELSE 'NON_MATCHING' END AS state FROM p""",
)
def flt14(spark, sf):
    pts = fx.points(spark, sf)
    exists = F.col("fid") % 10 != 1
    shape = F.when(F.col("fid") % 10 != 0, spatial.point(F.col("x"), F.col("y")))
    return pts.select("fid", spatial.Area([[AREA]]).state(exists, shape).alias("state"))


MOVED = fx.ctes(
    p=fx.POINTS,
    q="SELECT fid, CASE WHEN fid % 3 = 0 THEN x + 37 ELSE x END AS x, y, CASE WHEN fid % 5 = 0 THEN name || '!' ELSE name END AS name FROM p WHERE fid % 11 <> 0",
    d=fx.diff_sql("p", "q", "fid", ["fid", "x", "y", "name"]),
    m=f"SELECT *, {ray_sql('old_x', 'old_y')} AS old_in, {ray_sql('new_x', 'new_y')} AS new_in FROM d",
)


def moved_diff(spark, sf):
    shaped = fx.points(spark, sf).withColumn("geom", spatial.point(F.col("x"), F.col("y")))
    x = F.when(F.col("fid") % 3 == 0, F.col("x") + 37).otherwise(F.col("x"))
    name = F.when(F.col("fid") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))
    new = fx.points(spark, sf).filter("fid % 11 <> 0").withColumn("x", x).withColumn("name", name)
    new = new.withColumn("geom", spatial.point(F.col("x"), F.col("y")))
    return diffing.diff(shaped, new, ["fid"])


@query("FLT15", MOVED + "SELECT old_key, new_key, change_type FROM m WHERE coalesce(old_in, FALSE) OR coalesce(new_in, FALSE)")
def flt15(spark, sf):
    return spatial.filter_deltas(moved_diff(spark, sf), spatial.Area([[AREA]]), "geom").select("old_key", "new_key", "change_type")


@query("FLT16", MOVED + "SELECT old_key, new_key FROM m WHERE old_key IS NOT NULL AND new_key IS NOT NULL AND NOT old_in")
def flt16(spark, sf):
    return spatial.key_clashes(moved_diff(spark, sf), spatial.Area([[AREA]]), "geom").select("old_key", "new_key")


@query("FLT17", MOVED + "SELECT new_key AS key FROM m WHERE new_key IS NOT NULL AND NOT new_in")
def flt17(spark, sf):
    return spatial.now_outside(moved_diff(spark, sf), spatial.Area([[AREA]]), "geom")


@query("AGG15", MOVED + "SELECT 'points' AS dataset, CAST(count(*) AS BIGINT) AS n FROM m WHERE NOT coalesce(old_in, FALSE) AND NOT coalesce(new_in, FALSE)")
def agg15(spark, sf):
    return spatial.left_out(moved_diff(spark, sf), spatial.Area([[AREA]]), "geom", "points")


@query(
    "AGG3",
    MOVED
    + """SELECT CAST(count(*) FILTER (change_type = 'insert') AS BIGINT) AS inserts, CAST(count(*) FILTER (change_type = 'update' AND old_in) AS BIGINT) AS updates,
 CAST(count(*) FILTER (change_type = 'delete') AS BIGINT) AS deletes, CAST(count(*) FILTER (change_type = 'update' AND NOT old_in) AS BIGINT) AS spatial_filter_conflicts FROM m""",
)
def agg3(spark, sf):
    from tidemark.operators.aggregates import status_counts

    area = spatial.Area([[AREA]])
    return status_counts(moved_diff(spark, sf), ~area.matches(F.col("old.geom")))


@query("FLT20", "SELECT fid FROM (" + fx.POINTS + ") p WHERE fid % 6 NOT IN (0, 1)")
def flt20(spark, sf):
    n = F.col("fid") % 6
    shape = F.when(n == 0, F.lit(None).cast(spatial.GEOMETRY)).when(n == 1, spatial.empty("POINT")).otherwise(spatial.point(F.col("x"), F.col("y")))
    return fx.points(spark, sf).withColumn("geom", shape).filter(spatial.has_shape(F.col("geom"))).select("fid")
