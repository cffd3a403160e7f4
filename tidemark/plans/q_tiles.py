"""Tile catalogues made from ``part`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates, tiles
from tidemark.plans import fixtures as fx
from tidemark.plans.q_history import graph, graph_sql, seqs_of
from tidemark.plans.registry import query
from tidemark.plans.tilebytes import tile_files
from tidemark.session import spread
from tidemark.sources import tilefiles

PLACED = "SELECT p_partkey AS k, CAST(p_partkey % 300 - 150 AS DOUBLE) AS x, CAST(p_partkey % 140 - 70 AS DOUBLE) AS y FROM part"


def binary_files(spark, sf):
    """Rows as Spark's binaryFile source gives them."""
    p = fx.derive(spark, sf, PLACED)
    name = F.concat(F.lit("s3://bucket/tiles/t"), F.col("k").cast("string"), F.when(F.col("k") % 5 == 4, ".tif").otherwise(".laz"))
    return tile_files(spread(p).withColumn("path", name))


FORMAT = """CASE WHEN k % 5 = 4 THEN CASE WHEN k % 10 = 4 THEN 'geotiff/cog' ELSE 'geotiff' END ELSE CASE WHEN k % 2 = 1 THEN 'laz' ELSE 'las' END || '-1.' || CASE WHEN k % 3 = 0 THEN '2' ELSE '4' END
 || CASE WHEN k % 5 = 3 THEN '/copc-1.0' ELSE '' END END"""
CATALOGUE = fx.ctes(p=PLACED) + f"""SELECT 't' || CAST(k AS STRING) || CASE WHEN k % 5 = 4 THEN '.tif' ELSE '.laz' END AS name, {FORMAT} AS format, CASE WHEN k % 5 <> 4 THEN k END AS point_count,
 CASE WHEN k % 5 = 4 THEN CAST(k % 500 + 1 AS STRING) || 'x' || CAST(k % 300 + 1 AS STRING) END AS dimensions,
 CASE WHEN k % 5 <> 4 THEN concat_ws(',', CAST(x AS STRING), CAST(x + 10 AS STRING), CAST(y AS STRING), CAST(y + 20 AS STRING), '0.0', '5.0') END AS native_extent FROM p"""


@query("SRC14", CATALOGUE)
def src14(spark, sf):
    rows = tilefiles.catalogue(binary_files(spark, sf).drop("k"))
    extent = F.when(F.col("dimensions").isNull(), F.col("native_extent"))
    return rows.select("name", "format", "point_count", "dimensions", extent.alias("native_extent"))


@query("IMP11", fx.ctes(p=PLACED) + "SELECT 's3://bucket/tiles/t' || CAST(k AS STRING) || CASE WHEN k % 5 = 4 THEN '.tif' ELSE '.laz' END AS url, TRUE AS has_oid FROM p")
def imp11(spark, sf):
    """Linked tiles: the address is stored, the file stays where it is."""
    rows = tilefiles.catalogue(binary_files(spark, sf).drop("k"), url=True)
    return rows.select("url", F.col("oid").startswith("sha256:").alias("has_oid"))


FILES = """SELECT 'T' || CAST(p_partkey AS STRING) || '.TIF' AS name, substr(sha256(p_name), 1, 40) AS oid, CAST(p_partkey * 10 AS BIGINT) AS size FROM part
UNION ALL SELECT 't' || CAST(p_partkey AS STRING) || '.tif.aux.xml' AS name, substr(sha256(p_brand || p_name), 1, 40) AS oid, CAST(p_partkey AS BIGINT) AS size FROM part WHERE p_partkey % 3 = 0"""


def files(spark, sf):
    part = fx.table(spark, sf, "part")
    k = F.col("p_partkey")
    main = part.select(F.concat(F.lit("T"), k.cast("string"), F.lit(".TIF")).alias("name"), F.substring(F.sha2("p_name", 256), 1, 40).alias("oid"), (k * 10).alias("size"))
    side = part.filter(k % 3 == 0).select(
        F.concat(F.lit("t"), k.cast("string"), F.lit(".tif.aux.xml")).alias("name"), F.substring(F.sha2(F.concat("p_brand", "p_name"), 256), 1, 40).alias("oid"), k.alias("size")
    )
    return main.unionByName(side)


JOINED = """SELECT t.name, t.oid, t.size, s.name AS pam_name, s.oid AS pam_oid, s.size AS pam_size FROM (SELECT * FROM f WHERE name NOT LIKE '%.aux.xml') t
LEFT JOIN (SELECT * FROM f WHERE name LIKE '%.aux.xml') s ON lower(t.name) || '.aux.xml' = lower(s.name)"""


@query("JOI11", fx.ctes(f=FILES) + JOINED)
def joi11(spark, sf):
    return tiles.with_sidecars(files(spark, sf))


@query("SRC13", fx.ctes(f=FILES, j=JOINED) + "SELECT * FROM j WHERE size > 500 OR pam_oid IS NOT NULL")
def src13(spark, sf):
    """Tiles under a filter; a sidecar comes exactly when its tile does."""
    return tiles.scan(files(spark, sf), (F.col("size") > 500) | F.col("pam_oid").isNotNull())


POINTER = """SELECT p_partkey AS k, 'version 1' || chr(10) || 'oid sha256:' || sha256(p_name) || chr(10) || 'size ' || CAST(p_partkey * 7 AS STRING) || chr(10) || 'name dir/T' || CAST(p_partkey AS STRING) || '.LAS' || chr(10)
 || 'format ' || CASE WHEN p_partkey % 2 = 0 THEN 'laz-1.4/copc-1.0' ELSE 'las-1.2' END || chr(10) || 'nativeExtent 1,2,3,4,5,6' || chr(10) || 'crs84Extent POLYGON((0 0,1 1,1 0,0 0))' || chr(10) AS pointer, p_name FROM part"""


def pointers(spark, sf):
    return fx.derive(spark, sf, POINTER.replace("sha256(p_name)", "sha2(p_name, 256)"))


SUMMARY = """SELECT k, 'T' || CAST(k AS STRING) || CASE WHEN k % 2 = 0 THEN '.copc.laz' ELSE '.las' END AS name, CASE WHEN k % 2 = 0 THEN 'laz-1.4/copc-1.0' ELSE 'las-1.2' END AS format, 'sha256:' || sha256(p_name) AS oid,
 k * 7 AS size, '1,2,3,4,5,6' AS native_extent, 'POLYGON((0 0,1 1,1 0,0 0))' AS crs84_extent FROM (SELECT p_partkey AS k, p_name FROM part) p"""


@query("TIL1", SUMMARY)
def til1(spark, sf):
    return tiles.tile_summary(pointers(spark, sf), keep=["k"])


NAMES = """SELECT p_partkey AS k, 'dir/sub/T.' || p_brand || CASE p_partkey % 7 WHEN 0 THEN '.las' WHEN 1 THEN '.LAZ' WHEN 2 THEN '.copc.laz' WHEN 3 THEN '.tif' WHEN 4 THEN '.TIFF' WHEN 5 THEN '.tif.aux.xml' ELSE '.txt' END AS name FROM part"""


@query("TIL2", fx.ctes(n=NAMES) + "SELECT k, 'T.' || p_brand || CASE WHEN k % 7 = 6 THEN '.txt' ELSE '' END AS base, 'T.' || p_brand || CASE WHEN k % 7 = 6 THEN '.txt' ELSE '' END || '.copc.laz' AS as_copc, 'T.' || p_brand || CASE WHEN k % 7 = 6 THEN '.txt' ELSE '' END || CASE WHEN k % 7 = 5 THEN '.tif.aux.xml' ELSE '.tif' END AS as_raster FROM n JOIN part ON k = p_partkey")
def til2(spark, sf):
    n = fx.derive(spark, sf, NAMES)
    name = F.col("name")
    return n.select(
        "k", tiles.tile_name(name).alias("base"), tiles.with_extension(name, F.lit("laz-1.4/copc-1.0")).alias("as_copc"), tiles.with_extension(name, F.lit("geotiff/cog")).alias("as_raster")
    )


@query("TIL3", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'geotiff' || CASE WHEN p_partkey % 2 = 0 THEN '/cog' ELSE '' END ELSE 'laz-1.' || CAST(p_partkey % 5 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '/copc-1.0' ELSE '' END END AS summary FROM part")
def til3(spark, sf):
    k = F.col("p_partkey")
    cloud = tiles.format_summary(F.lit("laz"), F.concat(F.lit("1."), (k % 5).cast("string")), F.when(k % 2 == 0, F.lit("copc")), F.lit("1.0"))
    return fx.table(spark, sf, "part").select(k.alias("k"), F.when(k % 3 == 0, tiles.raster_format(k % 2 == 0)).otherwise(cloud).alias("summary"))


TYPED = "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'laz-1.4' WHEN 1 THEN 'laz-1.4/copc-1.0' ELSE 'laz-1.40' END AS f FROM part"


@query("TIL4", fx.ctes(t=TYPED) + "SELECT k, f = 'laz-1.4' OR starts_with(f, 'laz-1.4/') AS fits FROM t")
def til4(spark, sf):
    return fx.derive(spark, sf, TYPED).select("k", tiles.is_compatible(F.col("f"), F.lit("laz-1.4")).alias("fits"))


@query(
    "TIL5",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '6' ELSE '7' END AS copc_pdrf, CAST(CASE WHEN p_partkey % 2 = 0 THEN 28 - 28 + 30 ELSE 34 + 4 - 34 + 36 END AS STRING) AS copc_length, 'copc' AS copc_optimization,
 FALSE AS relaxed_has_optimization, 0 AS dropped FROM part""",
)
def til5(spark, sf):
    k = F.col("p_partkey")
    fmt = F.create_map(
        F.lit("compression"), F.lit("las"), F.lit("lasVersion"), F.lit("1.2"), F.lit("optimization"), F.lit("none"), F.lit("pointDataRecordFormat"),
        F.when(k % 2 == 0, "1").otherwise("3"), F.lit("pointDataRecordLength"), F.when(k % 2 == 0, "28").otherwise("38"),
    )
    p = fx.table(spark, sf, "part").select(k.alias("k"), fmt.alias("f"))
    copc = tiles.relaxed_format(F.col("f"), "as_copc")
    return p.select("k", copc.alias("c"), tiles.relaxed_format(F.col("f"), "drop_optimization").alias("r"), tiles.relaxed_format(F.col("f"), "drop_format").alias("d")).select(
        "k", F.col("c")["pointDataRecordFormat"].alias("copc_pdrf"), F.col("c")["pointDataRecordLength"].alias("copc_length"), F.col("c")["optimization"].alias("copc_optimization"),
        F.map_contains_key("r", "optimization").alias("relaxed_has_optimization"), F.size("d").alias("dropped"),
    )


@query(
    "TIL6",
    fx.ctes(s=SUMMARY)
    + """SELECT 'T' || CAST(k AS STRING) || '.copc.laz' AS name, 'laz-1.4/copc-1.0' AS format, CASE WHEN k % 2 = 0 THEN oid END AS oid, CASE WHEN k % 2 = 0 THEN size END AS size, CASE WHEN k % 2 = 1 THEN name END AS source_name,
 CASE WHEN k % 2 = 1 THEN format END AS source_format, CASE WHEN k % 2 = 1 THEN oid END AS source_oid, CASE WHEN k % 2 = 1 THEN size END AS source_size FROM s""",
)
def til6(spark, sf):
    return tiles.envisioned(tiles.tile_summary(pointers(spark, sf)), "laz-1.4/copc-1.0")


XML = """SELECT p_partkey AS k, '<PAMDataset><PAMRasterBand band="1"><CategoryNames><Category>' || p_type || '</Category><Category>' || p_brand || '</Category></CategoryNames><Histograms><HistItem>' || p_name
 || '</HistItem></Histograms></PAMRasterBand></PAMDataset>' AS xml, p_type, p_brand FROM part"""


@query("TIL8", fx.ctes(x=XML) + "SELECT k, 0 AS number, p_type AS label FROM x UNION ALL SELECT k, 1 AS number, p_brand AS label FROM x")
def til8(spark, sf):
    x = fx.derive(spark, sf, XML)
    return x.select("k", F.posexplode(tiles.category_labels(F.col("xml"))).alias("number", "label"))


@query("AGG13", """SELECT number, min(label) AS label, min(label) <> max(label) AS conflict FROM (SELECT p_partkey % 50 AS number, CASE WHEN p_partkey % 100 < 50 THEN p_type ELSE p_brand END AS label FROM part) l GROUP BY number""")
def agg13(spark, sf):
    k = F.col("p_partkey")
    labels = fx.table(spark, sf, "part").select((k % 50).alias("number"), F.when(k % 100 < 50, F.col("p_type")).otherwise(F.col("p_brand")).alias("label"))
    return aggregates.merge_labels(labels, [], "number", "label")


ITEMS = """SELECT p_brand AS dataset, 'format.json' AS item, CASE WHEN p_size % 2 = 0 THEN 'laz' ELSE 'las' END AS value FROM part UNION ALL SELECT p_brand AS dataset, 'crs.wkt' AS item, 'EPSG:2193' AS value FROM part
UNION ALL SELECT p_brand AS dataset, 'schema.json' AS item, p_type AS value FROM part"""


@query("AGG12", fx.ctes(i=ITEMS) + "SELECT dataset, item, CAST(count(DISTINCT value) AS BIGINT) AS n_values, min(value) AS value, count(DISTINCT value) > 1 AS conflict FROM i GROUP BY 1, 2")
def agg12(spark, sf):
    return aggregates.merge_metadata(fx.derive(spark, sf, ITEMS), ["dataset"], "item", "value")


@query("AGG12_VALUES", fx.ctes(i=ITEMS) + "SELECT DISTINCT dataset, item, value FROM i WHERE (dataset, item) IN (SELECT dataset, item FROM i GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)")
def agg12_values(spark, sf):
    """A list of conflicts: every distinct value of an item that has several."""
    return aggregates.conflicting_values(fx.derive(spark, sf, ITEMS), ["dataset"], "item", "value")


NEW_FILES = """SELECT CASE WHEN k % 11 = 0 THEN replace(name, 'T', 'N') ELSE name END AS name, CASE WHEN k % 7 = 0 THEN oid || '0' ELSE oid END AS oid, size FROM (SELECT *, size // CASE WHEN name LIKE '%.aux.xml' THEN 1 ELSE 10 END AS k FROM f) g WHERE k % 5 <> 4"""


def new_files(spark, sf):
    f = files(spark, sf)
    k = F.when(tiles.is_sidecar(F.col("name")), F.col("size")).otherwise((F.col("size") / 10).cast("bigint"))
    g = f.withColumn("k", k).filter("k % 5 <> 4")
    return g.select(
        F.when(F.col("k") % 11 == 0, F.replace("name", F.lit("T"), F.lit("N"))).otherwise(F.col("name")).alias("name"),
        F.when(F.col("k") % 7 == 0, F.concat("oid", F.lit("0"))).otherwise(F.col("oid")).alias("oid"), "size",
    )


TILE_DIFF = """SELECT coalesce(a.t, b.t) AS tile, CASE WHEN a.t IS NULL THEN 'insert' WHEN b.t IS NULL THEN 'delete' ELSE 'update' END AS change_type, a.oid AS old_oid, b.oid AS new_oid, a.pam_oid AS old_pam, b.pam_oid AS new_pam
FROM (SELECT replace(lower(name), '.tif', '') AS t, * FROM jo) a FULL OUTER JOIN (SELECT replace(lower(name), '.tif', '') AS t, * FROM jn) b ON a.t = b.t
WHERE a.t IS NULL OR b.t IS NULL OR a.oid IS DISTINCT FROM b.oid OR a.pam_oid IS DISTINCT FROM b.pam_oid"""
TILE_CTES = fx.ctes(f=FILES, n=NEW_FILES, jo=JOINED, jn=JOINED.replace("FROM f ", "FROM n "), d=TILE_DIFF)


def shown(delta):
    return delta.select(
        "tile", "change_type", F.col("old.oid").alias("old_oid"), F.col("new.oid").alias("new_oid"), F.col("old.pam_oid").alias("old_pam"), F.col("new.pam_oid").alias("new_pam")
    )


@query("DIF17", TILE_CTES + "SELECT * FROM d")
def dif17(spark, sf):
    return shown(tiles.tile_diff(files(spark, sf), new_files(spark, sf)))


@query("WSP15", TILE_CTES + "SELECT tile, change_type, 1 AS flags FROM d")
def wsp15(spark, sf):
    """Changed files of a workspace folder as tile deltas, flagged as edits."""
    from tidemark.operators.diffing import WORKSPACE_EDIT

    return tiles.tile_diff(files(spark, sf), new_files(spark, sf)).select("tile", "change_type", F.lit(WORKSPACE_EDIT).alias("flags"))


@query("DIF18", TILE_CTES + "SELECT * FROM d WHERE NOT (change_type = 'update' AND old_oid = new_oid)")
def dif18(spark, sf):
    """Updates of nothing but the sidecar are left out."""
    return shown(tiles.major_changes(tiles.tile_diff(files(spark, sf), new_files(spark, sf)), ["name", "pam_oid"]))


@query("DIF18_XML", fx.ctes(x=XML) + "SELECT k, k % 3 <> 0 AS same FROM x")
def dif18_xml(spark, sf):
    """Sidecars that differ in statistics only count as equal."""
    x = fx.derive(spark, sf, XML)
    other = F.regexp_replace("xml", "<HistItem>.*</HistItem>", "<HistItem>1</HistItem>\n<HistItem>2</HistItem>")
    other = F.when(F.col("k") % 3 == 0, F.regexp_replace(other, "<Category>", "<Category>x")).otherwise(other)
    return x.select("k", (tiles.xml_without_statistics(F.col("xml")) == tiles.xml_without_statistics(other)).alias("same"))


INCOMING = "SELECT 'T' || CAST(p_partkey AS STRING) || '.laz' AS name, substr(sha256(p_name), 1, 40) AS oid, CASE WHEN p_partkey % 2 = 0 THEN 'laz-1.4/copc-1.0' ELSE 'laz-1.4' END AS format, 'EPSG:2193' AS crs, p_partkey AS k FROM part"
EXISTING = """SELECT lower(name) AS name, CASE WHEN k % 3 = 0 THEN 'new' ELSE oid END AS oid, CASE WHEN k % 3 = 0 THEN oid END AS source_oid, CASE WHEN k % 5 = 0 THEN 'laz-1.2' ELSE format END AS format,
 CASE WHEN k % 7 = 0 THEN 'EPSG:4326' ELSE crs END AS crs FROM i WHERE k % 4 <> 3"""


def incoming(spark, sf):
    return fx.derive(spark, sf, INCOMING.replace("sha256(p_name)", "sha2(p_name, 256)"))


def existing(spark, sf):
    return fx.derive(spark, sf, fx.ctes(i=INCOMING.replace("sha256(p_name)", "sha2(p_name, 256)")) + EXISTING)


@query("JOI15", fx.ctes(i=INCOMING) + "SELECT name, oid FROM i WHERE k % 4 = 3 OR (k % 5 = 0 AND k % 2 = 0) OR k % 7 = 0")
def joi15(spark, sf):
    return tiles.not_yet_imported(incoming(spark, sf), existing(spark, sf)).select("name", "oid")


@query("IMP10", fx.ctes(i=INCOMING, x=EXISTING) + "SELECT name, oid, format FROM i WHERE k % 9 <> 1 AND k % 6 <> 0 UNION ALL SELECT name, oid, format FROM x WHERE CAST(replace(replace(name, 't', ''), '.laz', '') AS BIGINT) % 9 = 1 AND CAST(replace(replace(name, 't', ''), '.laz', '') AS BIGINT) % 6 <> 0")
def imp10(spark, sf):
    """An update of existing tiles with most of the incoming ones, and some deleted by name."""
    some = incoming(spark, sf).filter("k % 9 <> 1").withColumn("source_oid", F.lit(None).cast("string"))
    gone = incoming(spark, sf).filter("k % 6 = 0").select("name")
    after = tiles.import_tiles(some, existing(spark, sf), "update", gone)
    return after.select("name", "oid", "format")


@query("IMP10_GATE", fx.ctes(i=INCOMING) + "SELECT 'crs.wkt' AS item, min(crs) AS value FROM i UNION ALL SELECT 'format.json' AS item, 'laz-1.4' AS value")
def imp10_gate(spark, sf):
    """Tiles must agree on their metadata; optimisation is left out of account."""
    i = incoming(spark, sf)
    items = i.select(F.lit("crs.wkt").alias("item"), F.col("crs").alias("value")).unionByName(
        i.select(F.lit("format.json").alias("item"), F.substring_index("format", "/", 1).alias("value"))
    )
    return tiles.homogeneous(items)


OBJECTS = "SELECT seq, md5(dataset || '/' || CAST(key AS STRING)) AS oid, dataset || '/' || CAST(key AS STRING) AS path, key * 100 AS size FROM changes WHERE op = 'put'"
STORED = "SELECT DISTINCT md5(dataset || '/' || CAST(key AS STRING)) AS oid, key * 100 AS size FROM changes WHERE key % 3 <> 0 UNION ALL SELECT DISTINCT md5('loose/' || CAST(key AS STRING)) AS oid, key * 7 AS size FROM changes WHERE key % 4 = 1"
TILE_REACH = graph_sql(changes=fx.CHANGES, objects=OBJECTS, stored=STORED, in_main="SELECT o.* FROM objects o WHERE seq IN (SELECT c.seq FROM commits c JOIN reach r ON c.commit_id = r.commit_id WHERE r.ref = 'release')")


def objects(spark, sf):
    return fx.derive(spark, sf, fx.ctes(changes=fx.CHANGES) + OBJECTS)


def stored(spark, sf):
    return fx.derive(spark, sf, fx.ctes(changes=fx.CHANGES) + STORED)


@query("TIL9", TILE_REACH + "SELECT m.oid, s.oid IS NOT NULL AS present, m.path, m.size FROM (SELECT oid, min(path) AS path, max(size) AS size FROM in_main GROUP BY oid) m LEFT JOIN stored s ON m.oid = s.oid")
def til9(spark, sf):
    """Content the release branch refers to, and whether it is there."""
    needed = objects(spark, sf).join(seqs_of(spark, sf, "release", graph(spark, sf)), "seq", "left_semi")
    return tiles.content_listing(needed, stored(spark, sf))


@query(
    "TIL10",
    TILE_REACH
    + """SELECT 'missing' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT DISTINCT oid, size FROM in_main WHERE oid NOT IN (SELECT oid FROM stored)) a
UNION ALL SELECT 'unreferenced' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM stored WHERE oid NOT IN (SELECT oid FROM in_main)""",
)
def til10(spark, sf):
    needed = objects(spark, sf).join(seqs_of(spark, sf, "release", graph(spark, sf)), "seq", "left_semi")
    return tiles.content_gaps(needed, stored(spark, sf), needed)
