import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import crs, envelopes, geometry, wkb
from tidemark.operators import spatial

UNIONS = [
    ((1, 2, 3, 4), (5, 6, 7, 8), (1, 2, 7, 8)),
    ((170, 2, 175, 4), (-165, 6, -160, 8), (170, 2, -160, 8)),
    ((0, 2, 10, 6), (170, 4, -150, 8), (170, 2, 10, 8)),
    ((0, 2, 10, 6), (160, 4, -160, 8), (0, 2, -160, 8)),
]


@pytest.mark.parametrize("a,b,expected", UNIONS)
def test_union(spark, a, b, expected):
    for left, right in ((a, b), (b, a)):
        boxes = [envelopes.lonlat_box(*[F.lit(float(v)) for v in box]) for box in (left, right)]
        got = spark.range(1).select(envelopes.union_all(F.array(*boxes)).alias("u")).first().u
        assert tuple(got) == pytest.approx(expected)


def test_bbox_edges(spark):
    def overlap(a, b):
        one, two = (spatial.box(*[F.lit(float(v)) for v in box]) for box in (a, b))
        return spark.range(1).select(spatial.boxes_overlap(one, two)).first()[0]

    assert overlap((0, 0, 2, 2), (1, 1, 3, 3))
    assert not overlap((0, 0, 2, 2), (2, 0, 3, 2))
    assert not overlap((0, 0, 2, 2), (0, 1, 0, 1))
    assert overlap((0, 0, 2, 2), (1, 1, 1, 1))


WKT = [
    "POINT(1 2)", "POINT Z(1 2 3)", "POINT EMPTY", "LINESTRING(0 0,1 1,2 0)", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))",
    "MULTIPOINT(1 2,3 4)", "MULTIPOINT((1 2),(3 4))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))",
    "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "POLYGON ZM((0 0 1 2,1 0 1 2,1 1 1 2,0 0 1 2))",
]


def test_wkt_wkb_round_trip(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WKT)], "i int, w string").select("i", geometry.from_wkt(F.col("w")).alias("g"))
    for encode in (wkb.to_wkb, wkb.to_gpkg, lambda g: wkb.to_ewkb(geometry.with_srid(g, 7))):
        back = df.select("i", "g", encode(F.col("g")).alias("b")).select("i", "g", wkb.decode(F.col("b")).alias("h"))
        for r in back.collect():
            a, b = r.g.asDict(True), r.h.asDict(True)
            a.pop("srid"), b.pop("srid")
            assert a == b, WKT[r.i]


def test_byte_order_and_opaque(spark):
    big = struct.pack(">BI2d", 0, 1, 5.0, 6.0)
    curve = struct.pack("<BII", 1, 8, 0)
    rows = spark.createDataFrame([(bytearray(big),), (bytearray(curve),), (bytearray(b"junk"),)], "b binary").select(wkb.decode(F.col("b")).alias("g")).collect()
    assert (rows[0].g.minx, rows[0].g.miny) == (5.0, 6.0)
    assert rows[1].g.kind == "CIRCULARSTRING" and rows[1].g.empty and rows[2].g is None


def test_geojson(spark):
    df = spark.createDataFrame([(w,) for w in WKT if " Z" not in w and "EMPTY" not in w], "w string").select(geometry.from_wkt(F.col("w")).alias("g"))
    back = df.select("g", geometry.from_geojson(geometry.to_geojson(F.col("g"))).alias("h"))
    assert all(r.g.parts == r.h.parts and r.g.kind == r.h.kind for r in back.collect())


def test_area_against_shapes(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0), (0.0, 0.0)]
    area = spatial.Area([[ring]])
    cases = {
        "POINT(5 8)": False, "POINT(5 2)": True, "LINESTRING(-5 9,15 9)": True, "LINESTRING(4 9,6 9)": False,
        "POLYGON((-5 -5,20 -5,20 20,-5 20,-5 -5))": True, "POLYGON((4 8,6 8,5 9,4 8))": False, "POLYGON((2 1,3 1,3 2,2 1))": True,
        "POINT EMPTY": True,
    }
    df = spark.createDataFrame([(w,) for w in cases], "w string").select("w", geometry.from_wkt(F.col("w")).alias("g"))
    got = {r.w: r.m for r in df.select("w", area.matches(F.col("g")).alias("m")).collect()}
    assert got == cases


def test_area_spec(spark):
    area = spatial.Area.parse("EPSG:4326;POLYGON((0 0,1 0,1 1,0 0))", spark)
    assert area.bounds == (0, 0, 1, 1) and area.within(0, 0, 2, 2) and not area.within(0.5, 0, 2, 2)
    assert spatial.Area.parse("none", spark) is None
    with pytest.raises(ValueError):
        spatial.Area.parse("EPSG:4326;POINT(1 1)", spark)
    moved = area.to_crs("EPSG:3857", spark)
    assert moved.bounds[2] == pytest.approx(111319.49, abs=0.01)


def test_known_projection_values(spark):
    x, y = crs.from_lonlat("EPSG:2193", F.lit(173.0), F.lit(0.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((1600000.0, 10000000.0))
    # Zone 31 central meridian at 45 degrees north: 0.9996 of the meridian arc 4984944.378 m.
    x, y = crs.from_lonlat("EPSG:32631", F.lit(3.0), F.lit(45.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((500000.0, 0.9996 * 4984944.378), abs=0.01)


def test_box_across_antimeridian(spark):
    def box(values):
        e = envelopes.project_box("EPSG:2193", *[F.lit(float(v)) for v in values])
        return spark.range(1).select(e.alias("b")).first().b

    inside = box((1570000, 5170000, 1570100, 5170100))
    assert inside.problem is None and inside.w < inside.e
    across = box((2090000, 5000000, 2500000, 5200000))
    assert across.problem is None and across.e < across.w


def test_projected_box_covers_its_border(spark):
    rows = [(1000000.0 + 37000 * i, 4800000.0 + 91000 * (i % 17), 20000.0 * (i % 40), 31000.0 * (i % 23)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, dx double, dy double")
    df = df.withColumn("b", envelopes.project_box("EPSG:2193", F.col("x"), F.col("y"), F.col("x") + F.col("dx"), F.col("y") + F.col("dy")))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(16))))
    for x, y in ((F.col("x") + F.col("dx") * F.col("k") / 16, F.col("y")), (F.col("x"), F.col("y") + F.col("dy") * F.col("k") / 16), (F.col("x") + F.col("dx") * F.col("k") / 16, F.col("y") + F.col("dy"))):
        lon, lat = crs.to_lonlat("EPSG:2193", x, y)
        east = F.pmod(lon - F.col("b.w"), F.lit(360.0)) <= F.pmod(F.col("b.e") - F.col("b.w"), F.lit(360.0)) + 1e-9
        out = df.select((east & lat.between(F.col("b.s") - 1e-9, F.col("b.n") + 1e-9)).alias("ok"), "b.problem").agg(F.min("ok").alias("ok"), F.count("problem").alias("p")).first()
        assert out.ok and out.p == 0


def test_box_far_off_and_half_a_world(spark):
    def problem(crs_id, *values):
        return spark.range(1).select(envelopes.project_box(crs_id, *[F.lit(float(v)) for v in values]).alias("b")).first().b.problem

    assert problem("EPSG:4326", 1570000, 5170000, 1570100, 5170100) == "wrong_crs"
    assert problem("EPSG:4326", -179, 0, 179, 1) == "unclear" and problem("EPSG:4326", 0, 89, 1, 91) == "unclear"
    assert problem("EPSG:4326", 175, -1, 185, 1) is None


def test_extent_by_matches_pairwise_union(spark):
    rows = [("a", 170.0, 1.0, 175.0, 2.0), ("a", -179.0, 0.0, -160.0, 3.0), ("a", 176.0, 0.0, 178.0, 5.0), ("b", 10.0, 0.0, 20.0, 1.0), ("b", -20.0, -1.0, -10.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, w double, s double, e double, n double")
    df = df.select("k", envelopes.lonlat_box(*[F.col(c) for c in "wsen"]).alias("box"))
    got = {r.k: (r.w, r.s, r.e, r.n) for r in spatial.extent_by(df, ["k"]).collect()}
    assert got["a"] == pytest.approx((170.0, 0.0, -160.0, 5.0))
    assert got["b"] == pytest.approx((-20.0, -1.0, 20.0, 1.0))
    # A gap of half a degree in a ring of boxes is found too.
    ring = spark.createDataFrame([("g", float(w), 0.0, float(w + 1) if w < 179 else -180.0, 1.0) for w in range(-180, 180) if w != 40] + [("g", 40.5, 0.0, 41.0, 1.0)], "k string, w double, s double, e double, n double")
    found = spatial.extent_by(ring.select("k", envelopes.lonlat_box(*[F.col(c) for c in "wsen"]).alias("box")), ["k"]).first()
    assert (found.w, found.e) == pytest.approx((40.5, 40.0))
    around = spark.createDataFrame([("c", float(w), 0.0, float(w + 2 if w < 178 else w - 358), 1.0) for w in range(-180, 180)], "k string, w double, s double, e double, n double")
    around = around.select("k", envelopes.lonlat_box(*[F.col(c) for c in "wsen"]).alias("box"))
    assert tuple(spatial.extent_by(around, ["k"]).select("w", "e").first()) == (-180.0, 180.0)


def test_area_part_inside_a_polygon(spark):
    square = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]
    area = spatial.Area([square(100.0, 0.0, 1.0), square(5.0, 5.0, 1.0)])
    shape = geometry.from_wkt(F.lit("POLYGON((0 0,20 0,20 20,0 20,0 0))"))
    assert spark.range(1).select(area.intersects(shape).alias("hit")).first().hit


def test_unlisted_system_stays_out_of_the_index(spark):
    g = geometry.point(F.lit(10.0), F.lit(20.0))
    rows = spark.createDataFrame([("a", "EPSG:4326"), ("b", "EPSG:4326"), ("b", "EPSG:9999")], "oid string, crs string").withColumn("geom", g)
    assert [r.oid for r in spatial.index_entries(rows).collect()] == ["a"]


def collection(*members: bytes, order: str = "<", srid: int | None = None) -> bytes:
    mark = b"\x01" if order == "<" else b"\x00"
    code = struct.pack(order + "I", 7 if srid is None else 7 | 0x20000000) + (b"" if srid is None else struct.pack(order + "I", srid))
    return mark + code + struct.pack(order + "I", len(members)) + b"".join(members)


def test_collections_keep_their_bytes(spark, tmp_path):
    from tidemark.sinks.export import export

    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    curve = struct.pack("<BIIdddddd", 1, 8, 3, 0, 0, 1, 1, 2, 0)
    given = {1: collection(point), 2: collection(), 3: curve, 4: collection(point, order=">"), 5: collection(point, srid=2193), 6: b"junk", 7: struct.pack("<BII", 1, 99, 0)}
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "k int, b binary").withColumn("g", wkb.decode(F.col("b")))
    rows = {r.k: r for r in df.withColumn("out", wkb.to_wkb(F.col("g"))).withColumn("gp", wkb.to_gpkg(F.col("g"))).withColumn("again", wkb.decode(F.col("gp"))).collect()}
    assert [rows[k].g.empty for k in (1, 2, 3, 4, 5)] == [False, True, False, False, False]
    assert rows[3].g.kind == "CIRCULARSTRING" and rows[5].g.srid == 2193 and rows[6].g is None and rows[7].g is None
    assert all(bytes(rows[k].out) == given[k] for k in (1, 2, 3, 4))
    assert bytes(rows[5].out) == collection(point) and bytes(rows[1].gp)[8:] == given[1]
    assert rows[1].again.kind == "GEOMETRYCOLLECTION" and bytes(rows[1].again.raw) == given[1]
    area = spatial.Area.parse("EPSG:4326;POLYGON((50 50,51 50,51 51,50 50))", spark)
    assert df.filter("k = 1").select(area.matches(F.col("g")).alias("m")).first().m  # what is not decoded matches
    export(df.filter("k < 6").select("k", "g"), str(tmp_path / "out"), "parquet", geom="g", pk="k", drop_null=True, drop_empty=True)
    assert {r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3, 4, 5}
    with pytest.raises(Exception, match="cannot be moved"):
        df.filter("k = 1").select(spatial.reproject(F.col("g"), "EPSG:4326", "EPSG:3857", F.col("k"))).collect()
