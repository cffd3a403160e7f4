"""Geometry decoding, boxes, projections and the box index."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import crs, envelopes, geometry, wkb
from tidemark.operators import history, spatial
from tidemark.plans import fixtures as fx
from tidemark.plans.q_scalars import wrap_sql
from tidemark.plans.registry import query
from tidemark.session import spread

#: Points, lines, boxes and empty shapes made from customer keys.
SHAPES = """SELECT fid, x, y, name, CAST(fid % 4 AS INTEGER) AS shape FROM (SELECT c_custkey AS fid, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 170 - 85 AS DOUBLE) AS y, c_name AS name FROM customer) p"""
KIND_SQL = "CASE shape WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' WHEN 2 THEN 'POLYGON' ELSE 'POINT' END"
BOX_SQL = "CASE WHEN shape < 3 THEN x END AS minx, CASE WHEN shape < 3 THEN y END AS miny, CASE shape WHEN 0 THEN x WHEN 1 THEN x + 3 WHEN 2 THEN x + 2 END AS maxx, CASE shape WHEN 0 THEN y WHEN 1 THEN y + 1 WHEN 2 THEN y + 1 END AS maxy"
WITH = fx.ctes(shapes=SHAPES)


def shapes(spark, sf, dealt=False):
    """Shapes of all kinds; ``dealt`` to all tasks where each goes through Python."""
    s = fx.derive(spark, sf, SHAPES)
    s = spread(s) if dealt else s
    x, y = F.col("x"), F.col("y")
    line = geometry.build("LINESTRING", F.array(F.array(F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 3, y + 1)))))
    geom = (
        F.when(F.col("shape") == 0, geometry.point(x, y)).when(F.col("shape") == 1, line)
        .when(F.col("shape") == 2, geometry.polygon_box(x, y, x + 2, y + 1)).otherwise(geometry.empty("POINT"))
    )
    return s.withColumn("geom", geom)


def box_columns(g="g"):
    return [F.col(f"{g}.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")]


@query("GEO1", WITH + f"SELECT fid, {KIND_SQL} AS kind, shape = 3 AS empty, CASE WHEN fid % 3 = 1 THEN 4326 ELSE 0 END AS srid, {BOX_SQL} FROM shapes")
def geo1(spark, sf):
    """WKB, EWKB and GeoPackage bytes decoded."""
    s = shapes(spark, sf, dealt=True)
    n = F.col("fid") % 3
    tagged = s.withColumn("geom", F.when(n == 1, geometry.with_srid(F.col("geom"), 4326)).otherwise(F.col("geom")))
    data = [
        tagged.filter(n == 0).select("fid", wkb.to_wkb(F.col("geom")).alias("b")),
        tagged.filter(n == 1).select("fid", wkb.to_ewkb(F.col("geom")).alias("b")),
        tagged.filter(n == 2).select("fid", wkb.to_gpkg(F.col("geom")).alias("b")),
    ]
    stored = data[0].unionByName(data[1]).unionByName(data[2])
    return stored.select("fid", wkb.decode(F.col("b")).alias("g")).select("fid", "g.kind", "g.empty", "g.srid", *box_columns())


WKT_SQL = """SELECT fid, x, y, CASE shape WHEN 0 THEN 'POINT (' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ')' WHEN 1 THEN 'SRID=4326;MULTIPOINT((' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || '),(0 0))'
 WHEN 2 THEN 'POLYGON Z((' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ' 5, ' || CAST(x + 1 AS STRING) || ' ' || CAST(y AS STRING) || ' 6, ' || CAST(x AS STRING) || ' ' || CAST(y + 1 AS STRING) || ' 7, '
  || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ' 5))' ELSE 'LINESTRING EMPTY' END AS wkt, shape FROM shapes"""


@query(
    "GEO2",
    fx.ctes(shapes=SHAPES, t=WKT_SQL)
    + """SELECT fid, CASE shape WHEN 0 THEN 'POINT' WHEN 1 THEN 'MULTIPOINT' WHEN 2 THEN 'POLYGON' ELSE 'LINESTRING' END AS kind, shape = 2 AS has_z, CASE WHEN shape = 1 THEN 4326 ELSE 0 END AS srid,
 CASE shape WHEN 0 THEN x WHEN 1 THEN least(x, 0) WHEN 2 THEN x END AS minx, CASE shape WHEN 0 THEN y WHEN 1 THEN least(y, 0) WHEN 2 THEN y END AS miny,
 CASE shape WHEN 0 THEN x WHEN 1 THEN greatest(x, 0) WHEN 2 THEN x + 1 END AS maxx, CASE shape WHEN 0 THEN y WHEN 1 THEN greatest(y, 0) WHEN 2 THEN y + 1 END AS maxy, CASE WHEN shape = 2 THEN 7.0::DOUBLE END AS maxz FROM t""",
)
def geo2(spark, sf):
    texts = fx.derive(spark, sf, fx.ctes(shapes=SHAPES) + WKT_SQL)
    return texts.select("fid", geometry.from_wkt(F.col("wkt")).alias("g")).select(
        "fid", "g.kind", "g.has_z", "g.srid", *box_columns(), F.col("g.maxz").alias("maxz")
    )


@query("GEO3", WITH + "SELECT fid, TRUE AS same_bytes, CASE shape WHEN 0 THEN 29 WHEN 1 THEN 8 + 32 + 9 + 48 WHEN 2 THEN 8 + 32 + 9 + 4 + 80 ELSE 29 END AS n_bytes FROM shapes")
def geo3(spark, sf):
    """However a geometry was encoded, its stored form has the same bytes."""
    s = shapes(spark, sf, dealt=True)
    a = wkb.decode(wkb.to_wkb(F.col("geom")))
    b = wkb.decode(wkb.to_ewkb(geometry.with_srid(F.col("geom"), 2193)))
    both = s.select("fid", wkb.to_gpkg(a).alias("a"), wkb.to_gpkg(b).alias("b"))
    return both.select("fid", (F.col("a") == F.col("b")).alias("same_bytes"), F.octet_length("a").alias("n_bytes"))


@query(
    "GEO4",
    WITH
    + """SELECT fid, CASE shape WHEN 0 THEN 42 WHEN 1 THEN 114 WHEN 2 THEN 186 ELSE 42 END AS hex_length, CASE shape
 WHEN 0 THEN '{"type":"Point","coordinates":[' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || ']}'
 WHEN 1 THEN '{"type":"LineString","coordinates":[[' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || '],[' || CAST(x + 1 AS STRING) || ',' || CAST(y AS STRING) || '],[' || CAST(x + 3 AS STRING) || ',' || CAST(y + 1 AS STRING) || ']]}'
 WHEN 2 THEN '{"type":"Polygon","coordinates":[[[' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || '],[' || CAST(x + 2 AS STRING) || ',' || CAST(y AS STRING) || '],[' || CAST(x + 2 AS STRING) || ',' || CAST(y + 1 AS STRING) || '],['
  || CAST(x AS STRING) || ',' || CAST(y + 1 AS STRING) || '],[' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || ']]]}'
 ELSE '{"type":"Point","coordinates":[]}' END AS geojson FROM shapes""",
)
def geo4(spark, sf):
    s = shapes(spark, sf, dealt=True)
    return s.select("fid", F.length(wkb.to_hex_wkb(F.col("geom"))).alias("hex_length"), geometry.to_geojson(F.col("geom")).alias("geojson"))


@query("GEO5", WITH + f"SELECT fid, {BOX_SQL} FROM shapes")
def geo5(spark, sf):
    s = shapes(spark, sf).select("fid", geometry.envelope(F.col("geom")).alias("g"))
    return s.select("fid", *box_columns())


@query("GEO6", WITH + f"SELECT fid, {KIND_SQL} || CASE WHEN fid % 5 = 0 THEN ' Z' ELSE '' END AS type_name, shape = 3 AS empty FROM shapes")
def geo6(spark, sf):
    flagged = F.col("geom").withField("has_z", F.col("fid") % 5 == 0)
    s = shapes(spark, sf).withColumn("geom", flagged)
    return s.select("fid", geometry.type_name(F.col("geom")).alias("type_name"), F.col("geom.empty").alias("empty"))


@query("GEO7", WITH + "SELECT fid, 2193 AS srid FROM shapes")
def geo7(spark, sf):
    return shapes(spark, sf).select("fid", geometry.with_srid(F.col("geom"), 2193)["srid"].alias("srid"))


WKT_CRS = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'GEOGCS["WGS 84",DATUM["D",AUTHORITY["EPSG","1"]],AUTHORITY["EPSG","' || CAST(c_custkey AS STRING) || '"]]'
 WHEN 1 THEN 'PROJCS["' || c_name || '",GEOGCS["g",AUTHORITY["EPSG","4326"]],UNIT["m",1]]' WHEN 2 THEN 'PROJCS["a",AUTHORITY["ESRI",' || CAST(c_custkey AS STRING) || ']]'
 ELSE 'unknown ' || c_name END AS wkt FROM customer"""


@query(
    "GEO8",
    fx.ctes(w=WKT_CRS)
    + """SELECT id, CASE id % 4 WHEN 0 THEN 'EPSG:' || CAST(id AS STRING) WHEN 1 THEN regexp_extract(wkt, 'PROJCS."([^"]+)"', 1) WHEN 2 THEN 'ESRI:' || CAST(id AS STRING)
 ELSE 'CUSTOM:' || CAST(CAST('0x' || substr(sha256(wkt), 1, 8) AS BIGINT) % 9200 + 200000 AS STRING) END AS identifier,
 CASE WHEN id % 4 IN (0, 2) THEN id ELSE CAST('0x' || substr(sha256(wkt), 1, 8) AS BIGINT) % 9200 + 200000 END AS number FROM w""",
)
def geo8(spark, sf):
    w = fx.derive(spark, sf, WKT_CRS)
    return w.select("id", crs.identifier(F.col("wkt")).alias("identifier"), crs.identifier_number(F.col("wkt")).alias("number"))


@query("GEO9", WITH + "SELECT fid, CASE shape WHEN 0 THEN 'POINT' WHEN 1 THEN 'MULTILINESTRING' WHEN 2 THEN 'MULTIPOLYGON' ELSE 'POINT' END AS kind, CASE WHEN shape = 3 THEN 0 ELSE 1 END AS members FROM shapes")
def geo9(spark, sf):
    s = shapes(spark, sf).select("fid", geometry.promote(F.col("geom")).alias("g"))
    return s.select("fid", "g.kind", F.size("g.parts").alias("members"))


def rounded(c, digits=3):
    return F.round(c, digits).cast(f"decimal(18,{digits})")


MERCATOR_X = "radians(x) * 6378137.0"
MERCATOR_Y = "ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0"


@query(
    "GEO11",
    WITH + f"SELECT fid, CAST(round({MERCATOR_X}, 3) AS DECIMAL(18,3)) AS mx, CAST(round({MERCATOR_Y}, 3) AS DECIMAL(18,3)) AS my, CAST(round(x, 6) AS DECIMAL(18,6)) AS back_x, CAST(round(y, 6) AS DECIMAL(18,6)) AS back_y FROM shapes WHERE shape = 0",
)
def geo11(spark, sf):
    s = shapes(spark, sf).filter("shape = 0")
    there = s.select("fid", spatial.reproject(F.col("geom"), "EPSG:4326", "EPSG:3857", F.col("fid")).alias("g"))
    back = there.withColumn("b", spatial.reproject(F.col("g"), "EPSG:3857", "EPSG:4326", F.col("fid")))
    return back.select(
        "fid", rounded(F.col("g.minx")).alias("mx"), rounded(F.col("g.miny")).alias("my"), rounded(F.col("b.minx"), 6).alias("back_x"), rounded(F.col("b.miny"), 6).alias("back_y")
    )


@query("GEO11_TM", WITH + "SELECT fid, CAST(round(173 + x / 60, 7) AS DECIMAL(18,7)) AS lon, CAST(round(-41 + y / 60, 7) AS DECIMAL(18,7)) AS lat FROM shapes WHERE shape = 0")
def geo11_tm(spark, sf):
    """Through a transverse Mercator grid and back."""
    s = shapes(spark, sf).filter("shape = 0")
    lon, lat = F.lit(173.0) + F.col("x") / 60, F.lit(-41.0) + F.col("y") / 60
    east, north = crs.from_lonlat("EPSG:2193", lon, lat)
    grid = s.select("fid", east.alias("e"), north.alias("n"))
    lon2, lat2 = crs.to_lonlat("EPSG:2193", F.col("e"), F.col("n"))
    return grid.select("fid", rounded(lon2, 7).alias("lon"), rounded(lat2, 7).alias("lat"))


BOXES = """SELECT fid, x AS w, y AS s, CASE WHEN x + k > 180 THEN x + k - 360 ELSE x + k END AS e, least(y + 3, 90) AS n FROM (SELECT c_custkey AS fid, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 170 - 85 AS DOUBLE) AS y, CAST(c_custkey % 23 + 1 AS DOUBLE) + 0.25 AS k FROM customer) b"""


@query(
    "GEO12",
    fx.ctes(b=BOXES)
    + """SELECT fid, printf('%05X', CAST(floor((w - -180.0) / 360.0 * 1048575) AS BIGINT)) || printf('%05X', CAST(floor((s - -90.0) / 180.0 * 1048575) AS BIGINT))
 || printf('%05X', CAST(ceil((e - -180.0) / 360.0 * 1048575) AS BIGINT)) || printf('%05X', CAST(ceil((n - -90.0) / 180.0 * 1048575) AS BIGINT)) AS code, TRUE AS contains FROM b""",
)
def geo12(spark, sf):
    b = fx.derive(spark, sf, BOXES)
    code = envelopes.quantise(envelopes.lonlat_box(*[F.col(c) for c in "wsen"]))
    out = b.withColumn("code", code).withColumn("q", envelopes.unquantise(F.col("code")))
    inside = (F.col("q.w") <= F.col("w")) & (F.col("q.s") <= F.col("s")) & (F.col("q.e") >= F.col("e")) & (F.col("q.n") >= F.col("n"))
    return out.select("fid", F.hex("code").alias("code"), inside.alias("contains"))


NATIVE = "SELECT c_custkey AS fid, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x0, CAST(c_custkey % 178 - 89 AS DOUBLE) AS y0, CAST(c_custkey % 360 - 180 AS DOUBLE) + c_custkey % 4 * 0.25 AS x1, CAST(c_custkey % 178 - 89 AS DOUBLE) + c_custkey % 4 * 0.75 AS y1 FROM customer"


@query(
    "GEO13",
    fx.ctes(
        b=NATIVE,
        m="SELECT *, greatest(x1 - x0, y1 - y0) AS size, y1 > 90 AS bad FROM b",
        k="SELECT *, CASE WHEN size = 0 THEN 0.0 WHEN size < 1 THEN size * 0.1 ELSE 0.1 END AS buffer FROM m",
    )
    + f"""SELECT fid, CASE WHEN NOT bad THEN CAST(round({wrap_sql('(x0 - buffer)')}, 9) AS DECIMAL(18,9)) END AS w, CASE WHEN NOT bad THEN CAST(round(greatest(y0 - buffer, -90), 9) AS DECIMAL(18,9)) END AS s,
 CASE WHEN NOT bad THEN CAST(round({wrap_sql('(x1 + buffer)')}, 9) AS DECIMAL(18,9)) END AS e, CASE WHEN NOT bad THEN CAST(round(least(y1 + buffer, 90), 9) AS DECIMAL(18,9)) END AS n, CASE WHEN bad THEN 'unclear' END AS problem FROM k""",
)
def geo13(spark, sf):
    b = fx.derive(spark, sf, NATIVE)
    box = envelopes.project_box("EPSG:4326", *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    out = b.select("fid", box.alias("b"))
    return out.select("fid", *[rounded(F.col(f"b.{c}"), 9).alias(c) for c in "wsen"], F.col("b.problem").alias("problem"))


@query("GEO13_TM", fx.ctes(b=NATIVE) + "SELECT fid, TRUE AS covers, TRUE AS narrow, CAST(NULL AS STRING) AS problem FROM b")
def geo13_tm(spark, sf):
    """Boxes of a transverse Mercator grid, some across the antimeridian: each holds its border and is not much wider."""
    b = fx.derive(spark, sf, NATIVE)
    k = F.col("fid")
    x0, y0 = F.lit(1000000.0) + k % 1500 * 1000, F.lit(4800000.0) + k % 1300 * 1000
    x1, y1 = x0 + k % 7 * 60000, y0 + k % 5 * 40000
    edges = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), ((x0 + x1) / 2, y0), ((x0 + x1) / 2, y1))
    places = F.array(*[crs.lonlat_point("EPSG:2193", x, y) for x, y in edges])
    boxes = spread(b).select("fid", envelopes.project_box("EPSG:2193", x0, y0, x1, y1).alias("b"), places.alias("p"))
    east = [F.pmod(F.col("p")[i]["x"] - F.col("b.w"), F.lit(360.0)) for i in range(len(edges))]
    lats = [F.col("p")[i]["y"] for i in range(len(edges))]
    width = F.pmod(F.col("b.e") - F.col("b.w"), F.lit(360.0))
    covers = (F.greatest(*east) <= width + 1e-9) & (F.least(*lats) >= F.col("b.s") - 1e-9) & (F.greatest(*lats) <= F.col("b.n") + 1e-9)
    narrow = (width <= F.greatest(*east) - F.least(*east) + 0.3) & (F.col("b.n") - F.col("b.s") <= F.greatest(*lats) - F.least(*lats) + 0.5)
    return boxes.select("fid", covers.alias("covers"), narrow.alias("narrow"), F.col("b.problem").alias("problem"))


RECTANGLE = [(-60.5, -30.5), (70.5, -30.5), (70.5, 40.5), (-60.5, 40.5), (-60.5, -30.5)]


@query(
    "GEO14",
    WITH
    + """SELECT fid, CASE shape WHEN 0 THEN x BETWEEN -60.5 AND 70.5 AND y BETWEEN -30.5 AND 40.5 WHEN 2 THEN x <= 70.5 AND x + 2 >= -60.5 AND y <= 40.5 AND y + 1 >= -30.5 END AS hits FROM shapes WHERE shape IN (0, 2)""",
)
def geo14(spark, sf):
    s = shapes(spark, sf).filter("shape IN (0, 2)")
    return s.select("fid", spatial.Area([[RECTANGLE]]).intersects(F.col("geom")).alias("hits"))


@query(
    "GEO14_LINES",
    WITH
    + """SELECT fid, CASE shape WHEN 0 THEN x BETWEEN -60.5 AND 70.5 AND y BETWEEN -30.5 AND 40.5 WHEN 2 THEN x <= 70.5 AND x + 2 >= -60.5 AND y <= 40.5 AND y + 1 >= -30.5
 WHEN 1 THEN (y BETWEEN -30.5 AND 40.5 AND x <= 70.5 AND x + 1 >= -60.5) OR greatest(0, (-61.5 - x) / 2, -30.5 - y) <= least(1, (69.5 - x) / 2, 40.5 - y) ELSE TRUE END AS hits FROM shapes""",
)
def geo14_lines(spark, sf):
    """All kinds, lines of two segments among them; empty shapes match."""
    s = shapes(spark, sf)
    return s.select("fid", spatial.Area([[RECTANGLE]]).matches(F.col("geom")).alias("hits"))


@query(
    "GEO15",
    fx.ctes(b=BOXES)
    + f"""SELECT fid, CASE WHEN w <= e THEN e ELSE e + 360 END AS unwrapped, CASE WHEN abs((greatest(a, c) - least(a, c)) - (ue - w)) <= 0.001 THEN least(a, c) ELSE greatest(a, c) END AS w2,
 CASE WHEN abs((greatest(a, c) - least(a, c)) - (ue - w)) <= 0.001 THEN greatest(a, c) ELSE least(a, c) END AS e2 FROM (SELECT *, {wrap_sql('w')} AS a, {wrap_sql('ue')} AS c FROM (SELECT *, CASE WHEN w <= e THEN e ELSE e + 360 END AS ue FROM b) u) v""",
)
def geo15(spark, sf):
    b = fx.derive(spark, sf, BOXES).withColumn("u", envelopes.unwrap_east(F.col("w"), F.col("e")))
    w2, e2 = envelopes.wrap_edges(F.col("w"), F.col("u"))
    return b.select("fid", F.col("u").alias("unwrapped"), w2.alias("w2"), e2.alias("e2"))


def union_sql(source: str) -> str:
    """Union of two boxes (w1..n1, w2..n2) of ``source`` in plain SQL."""
    return f"""SELECT fid, CASE WHEN re - rw >= 360 THEN -180.0 WHEN plain THEN least(a, c) ELSE greatest(a, c) END AS w, least(s1, s2) AS s,
 CASE WHEN re - rw >= 360 THEN 180.0 WHEN plain THEN greatest(a, c) ELSE least(a, c) END AS e, greatest(n1, n2) AS n
FROM (SELECT *, abs((greatest(a, c) - least(a, c)) - (re - rw)) <= 0.001 AS plain FROM (SELECT *, {wrap_sql('rw')} AS a, {wrap_sql('re')} AS c FROM (
 SELECT *, CASE WHEN d1 <= d2 AND d1 <= d3 THEN least(w1, w2 - 360) WHEN d2 <= d3 THEN least(w1, w2) ELSE least(w1, w2 + 360) END AS rw,
 CASE WHEN d1 <= d2 AND d1 <= d3 THEN greatest(u1, u2 - 360) WHEN d2 <= d3 THEN greatest(u1, u2) ELSE greatest(u1, u2 + 360) END AS re FROM (
 SELECT *, greatest(u1, u2 - 360) - least(w1, w2 - 360) AS d1, greatest(u1, u2) - least(w1, w2) AS d2, greatest(u1, u2 + 360) - least(w1, w2 + 360) AS d3 FROM (
 SELECT *, CASE WHEN w1 <= e1 THEN e1 ELSE e1 + 360 END AS u1, CASE WHEN w2 <= e2 THEN e2 ELSE e2 + 360 END AS u2 FROM {source}) q1) q2) q3) q4) q5"""


TWO_BOXES = """SELECT a.fid, a.w AS w1, a.s AS s1, a.e AS e1, a.n AS n1, b.w AS w2, b.s AS s2, b.e AS e2, b.n AS n2 FROM b a JOIN b b ON b.fid = a.fid + 150"""


@query("AGG14", fx.ctes(b=BOXES, two=TWO_BOXES) + union_sql("two"))
def agg14(spark, sf):
    b = fx.derive(spark, sf, BOXES).select("fid", envelopes.lonlat_box(*[F.col(c) for c in "wsen"]).alias("box"))
    other = b.select((F.col("fid") - 150).alias("fid"), F.col("box").alias("other"))
    joined = b.join(other, "fid").select("fid", envelopes.union_all(F.array("box", "other")).alias("u"))
    return joined.select("fid", "u.w", "u.s", "u.e", "u.n")


@query(
    "AGG14_EXTENT",
    fx.ctes(
        b=BOXES,
        r="SELECT c_nationkey, w, CASE WHEN w <= e THEN e ELSE e + 360 END AS e, s, n FROM b JOIN customer ON c_custkey = fid",
        g="SELECT *, w - greatest(coalesce(max(e) OVER (PARTITION BY c_nationkey ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000.0), max(e) OVER (PARTITION BY c_nationkey) - 360) AS gap FROM r",
        k="SELECT c_nationkey, max(gap) AS gap, min(s) AS s, max(n) AS n FROM g GROUP BY c_nationkey",
        p="SELECT k.c_nationkey, k.gap, k.s, k.n, min(g.w) AS w, min(g.w) + 360 - k.gap AS e FROM k JOIN g ON g.c_nationkey = k.c_nationkey AND g.gap = k.gap GROUP BY k.c_nationkey, k.gap, k.s, k.n",
        q=f"SELECT *, {wrap_sql('w')} AS a, {wrap_sql('e')} AS c FROM p",
    )
    + """SELECT c_nationkey, CASE WHEN gap <= 0 THEN -180.0 WHEN abs((greatest(a, c) - least(a, c)) - (e - w)) <= 0.001 THEN least(a, c) ELSE greatest(a, c) END AS w, s,
 CASE WHEN gap <= 0 THEN 180.0 WHEN abs((greatest(a, c) - least(a, c)) - (e - w)) <= 0.001 THEN greatest(a, c) ELSE least(a, c) END AS e, n FROM q""",
)
def agg14_extent(spark, sf):
    """Extent of every nation's boxes, the antimeridian included."""
    b = fx.derive(spark, sf, BOXES).select("fid", envelopes.lonlat_box(*[F.col(c) for c in "wsen"]).alias("box"))
    nation = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), "c_nationkey")
    return spatial.extent_by(b.join(nation, "fid"), ["c_nationkey"])


CHANGED_POINTS = """SELECT seq, dataset, key, CAST(key % 360 - 180 AS DOUBLE) AS x, CAST(key % 170 - 85 AS DOUBLE) AS y, dataset || '/' || CAST(key AS STRING) || '/' || CAST(seq AS STRING) AS oid FROM changes WHERE op = 'put'"""
CRS_SEQ = "SELECT seq, event_type AS dataset, CASE WHEN seq < 12 THEN 'EPSG:4326' ELSE 'EPSG:3857' END AS crs FROM (SELECT DISTINCT " + fx.SEQ + " AS seq, event_type FROM events) e"
INDEXED = fx.ctes(
    changes=fx.CHANGES,
    pts=CHANGED_POINTS,
    h=CRS_SEQ,
    last_="SELECT dataset, crs, max(seq) AS last_seq FROM h GROUP BY 1, 2",
    both_="SELECT p.oid AS fid, x AS w1, y AS s1, x AS e1, y AS n1, degrees(x / 6378137.0) AS w2, degrees(atan(sinh(y / 6378137.0))) AS s2, degrees(x / 6378137.0) AS e2, degrees(atan(sinh(y / 6378137.0))) AS n2, x, y, "
    "EXISTS (SELECT 1 FROM last_ l WHERE l.dataset = p.dataset AND l.crs = 'EPSG:4326' AND l.last_seq >= p.seq) AS early FROM pts p",
    united=union_sql("both_"),
    entries="SELECT b.fid AS oid, CASE WHEN early THEN u.w ELSE b.w2 END AS w, CASE WHEN early THEN u.s ELSE b.s2 END AS s, CASE WHEN early THEN u.e ELSE b.e2 END AS e, CASE WHEN early THEN u.n ELSE b.n2 END AS n FROM both_ b JOIN united u ON b.fid = u.fid",
)
ROUNDED = ", ".join(f"CAST(round({c}, 6) AS DECIMAL(18,6)) AS {c}" for c in "wsen")
KNOWN = ["EPSG:4326", "EPSG:3857"]


def changed_points(spark, sf):
    pts = fx.derive(spark, sf, fx.ctes(changes=fx.CHANGES) + CHANGED_POINTS)
    return pts.withColumn("geom", geometry.point(F.col("x"), F.col("y")))


def applicable(spark, sf):
    return history.crs_applicable(changed_points(spark, sf), fx.derive(spark, sf, CRS_SEQ))


def entry_columns(index):
    return index.select("oid", *[rounded(F.col(f"box.{c}"), 6).alias(c) for c in "wsen"])


@query("GEO16", INDEXED + f"SELECT oid, {ROUNDED} FROM entries")
def geo16(spark, sf):
    return entry_columns(spatial.index_entries(applicable(spark, sf), known=KNOWN))


@query("GEO17", INDEXED + f"SELECT oid, {ROUNDED} FROM entries")
def geo17(spark, sf):
    """Half of the history indexed, then the rest; a third run adds nothing."""
    objects = applicable(spark, sf)
    first = spatial.index_entries(objects.filter("seq < 15"), known=KNOWN)
    second = spatial.index_new(objects, first, known=KNOWN)
    both = first.unionByName(second)
    return entry_columns(both.unionByName(spatial.index_new(objects, both, known=KNOWN)))


@query(
    "GEO18",
    INDEXED
    + "SELECT p.oid FROM pts p LEFT JOIN (SELECT * FROM entries WHERE oid NOT LIKE 'error%') i ON p.oid = i.oid WHERE i.oid IS NULL OR (s <= 40 AND n >= 20 AND ((CASE WHEN w <= e THEN e ELSE e + 360 END >= 30 AND w <= 90) OR (CASE WHEN w <= e THEN e ELSE e + 360 END >= 390 AND w <= 450)))",
)
def geo18(spark, sf):
    """Rows that may lie in a box; rows the index lacks are kept."""
    index = spatial.index_entries(applicable(spark, sf), known=KNOWN).filter(~F.col("oid").startswith("error"))
    return spatial.query_index(changed_points(spark, sf), index, (30.0, 20.0, 90.0, 40.0)).select("oid")


EXTENTS = "SELECT p_partkey AS id, p_partkey % 300 - 150 AS x, p_partkey % 150 - 75 AS y FROM part"


@query(
    "GEO20",
    fx.ctes(e=EXTENTS)
    + """SELECT id, CAST(x AS DOUBLE) AS minx, CAST(y + 2 AS DOUBLE) AS maxy, 'POLYGON((' || printf('%.7f', x::DOUBLE) || ' ' || printf('%.7f', y::DOUBLE) || ',' || printf('%.7f', x::DOUBLE) || ' ' || printf('%.7f', (y + 2)::DOUBLE) || ','
 || printf('%.7f', (x + 1)::DOUBLE) || ' ' || printf('%.7f', (y + 2)::DOUBLE) || ',' || printf('%.7f', (x + 1)::DOUBLE) || ' ' || printf('%.7f', y::DOUBLE) || ',' || printf('%.7f', x::DOUBLE) || ' ' || printf('%.7f', y::DOUBLE) || '))' AS ring FROM e""",
)
def geo20(spark, sf):
    from tidemark.operators.tiles import corner_ring, native_box

    e = fx.derive(spark, sf, EXTENTS)
    text = F.concat_ws(",", *[c.cast("string") for c in (F.col("x"), F.col("x") + 1, F.col("y"), F.col("y") + 2, F.lit(0), F.lit(9))])
    out = e.select("id", native_box(text).alias("b"))
    return out.select("id", F.col("b.minx").alias("minx"), F.col("b.maxy").alias("maxy"), corner_ring(F.col("b"), "EPSG:4326").alias("ring"))


# -- vector sources and export --------------------------------------------------------


@query("SRC11", fx.ctes(p=fx.POINTS) + "SELECT CAST(fid AS STRING) AS id, fid, name, x, y FROM p")
def src11(spark, sf):
    """Feature collections of a hundred features each, read back."""
    from tidemark.sinks.render import rows_geojson
    from tidemark.sources import geojson

    p = fx.points(spark, sf).select("fid", "name", spatial.point(F.col("x"), F.col("y")).alias("geom"))
    lines = rows_geojson(p, "fid").withColumn("_doc", F.floor(F.col("key") / 100))
    docs = lines.groupBy("_doc").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("feature")), F.lit("]}")).alias("doc")
    )
    kinds = T.StructType([T.StructField("fid", T.LongType()), T.StructField("name", T.StringType())])
    rows = geojson.features(docs, kinds)
    return rows.select("id", "fid", "name", F.col("geom.minx").alias("x"), F.col("geom.miny").alias("y"))


@query("SRC8", WITH + "SELECT fid, CAST(x AS DECIMAL(10,2)) AS area, 'MULTIPOLYGON' AS kind, x AS minx FROM shapes WHERE shape = 2")
def src8(spark, sf):
    """A vector file's rows by its typing rules; polygons become multipolygons."""
    from tidemark.schema import file_source_type
    from tidemark.sources.tables import read_features

    raw = fx.derive(spark, sf, fx.ctes(shapes=SHAPES, t=WKT_SQL) + "SELECT fid, CAST(x AS STRING) AS area, wkt FROM t WHERE shape = 2")
    fields = {"fid": file_source_type("GeoJSON", "Integer64"), "area": file_source_type("GPKG", "Real", 10, 2)}
    rows = read_features(raw, fields, "wkt", promote=True)
    return rows.select("fid", "area", F.col("geom.kind").alias("kind"), F.col("geom.minx").alias("minx"))


@query("SNK1", WITH + f"SELECT fid, name, CAST(round({MERCATOR_X}, 3) AS DECIMAL(18,3)) AS minx FROM shapes WHERE shape <> 3 AND name IS NOT NULL")
def snk1(spark, sf):
    """Export to a file in web mercator without empty shapes, read back."""
    from tidemark.session import scratch_path
    from tidemark.sinks.export import export

    path = scratch_path(spark, "export")
    export(shapes(spark, sf, dealt=True).select("fid", "name", "geom"), path, "parquet", geom="geom", pk="fid", source_crs="EPSG:4326", target_crs="EPSG:3857", drop_empty=True)
    out = spark.read.parquet(path)
    return out.select("fid", "name", wkb.decode(F.col("geom")).alias("g")).select("fid", "name", rounded(F.col("g.minx")).alias("minx"))
