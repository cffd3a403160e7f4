"""Geometry as a native struct, with JVM-side expressions over it.

A geometry is decoded once, when a table is read, into::

    kind, has_z, has_m, srid, empty, minx, miny, maxx, maxy, minz, maxz,
    parts: members -> rings or lines -> points -> [x, y(, z)(, m)]
    raw: the bytes of collections and curves, which are not decoded; they have no parts and no box

The box is kept as plain doubles, so box filters reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "array<array<array<array<double>>>>"
GEOMETRY = (
    "struct<kind:string,has_z:boolean,has_m:boolean,srid:int,empty:boolean,minx:double,miny:double,"
    f"maxx:double,maxy:double,minz:double,maxz:double,parts:{PARTS},raw:binary>"
)

#: WKB type codes of the kinds that are decoded (fixed values).
KINDS = {
    1: "POINT",
    2: "LINESTRING",
    3: "POLYGON",
    4: "MULTIPOINT",
    5: "MULTILINESTRING",
    6: "MULTIPOLYGON",
    7: "GEOMETRYCOLLECTION",
}
#: Codes of the kinds that are kept as bytes (fixed values).
OPAQUE = {
    7: "GEOMETRYCOLLECTION", 8: "CIRCULARSTRING", 9: "COMPOUNDCURVE", 10: "CURVEPOLYGON", 11: "MULTICURVE", 12: "MULTISURFACE",
    15: "POLYHEDRALSURFACE", 16: "TIN", 17: "TRIANGLE",
}


def all_points(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _struct(kind, has_z, has_m, srid, parts) -> Column:
    """Geometry struct of known parts; the box is read off the points."""

    def whole(head: Column) -> Column:
        points = F.filter(all_points(head["parts"]), lambda p: ~F.isnan(p[0]) & ~F.isnan(p[1]))
        # One variable that holds both: an inner lambda that reaches for an outer variable
        # keeps Spark from recognising a Python function this expression is passed to.
        return let(F.struct(head.alias("head"), points.alias("points")), lambda t: boxed(t["head"], t["points"]))

    def boxed(head: Column, points: Column) -> Column:
        def low(i: int) -> Column:
            return F.array_min(F.transform(points, lambda p: F.get(p, F.lit(i))))

        def high(i: int) -> Column:
            return F.array_max(F.transform(points, lambda p: F.get(p, F.lit(i))))

        return F.struct(
            head["kind"].alias("kind"),
            head["has_z"].alias("has_z"),
            head["has_m"].alias("has_m"),
            head["srid"].alias("srid"),
            F.coalesce(F.size(points) <= 0, F.lit(True)).alias("empty"),
            low(0).alias("minx"),
            low(1).alias("miny"),
            high(0).alias("maxx"),
            high(1).alias("maxy"),
            F.when(head["has_z"], low(2)).alias("minz"),
            F.when(head["has_z"], high(2)).alias("maxz"),
            head["parts"].alias("parts"),
            F.lit(None).cast("binary").alias("raw"),
        )

    head = F.struct(
        kind.alias("kind"), has_z.alias("has_z"), has_m.alias("has_m"), srid.cast("int").alias("srid"), parts.alias("parts")
    )
    return let(head, whole)


def build(kind: str, parts: Column, srid: int = 0) -> Column:
    return _struct(F.lit(kind), F.lit(False), F.lit(False), F.lit(srid), parts.cast(PARTS))


def point(x: Column, y: Column, srid: int = 0) -> Column:
    """A point, with its box written directly instead of searched for."""
    x, y = x.cast("double"), y.cast("double")
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit("POINT").alias("kind"),
        F.lit(False).alias("has_z"),
        F.lit(False).alias("has_m"),
        F.lit(srid).alias("srid"),
        F.lit(False).alias("empty"),
        x.alias("minx"),
        y.alias("miny"),
        x.alias("maxx"),
        y.alias("maxy"),
        none.alias("minz"),
        none.alias("maxz"),
        F.array(F.array(F.array(F.array(x, y)))).alias("parts"),
        F.lit(None).cast("binary").alias("raw"),
    )


def empty(kind: str) -> Column:
    return build(kind, F.array().cast(PARTS))


def polygon_box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Anticlockwise rectangle."""
    ring = F.array(F.array(minx, miny), F.array(maxx, miny), F.array(maxx, maxy), F.array(minx, maxy), F.array(minx, miny))
    return build("POLYGON", F.array(F.array(ring)))


def from_wkt(text: Column) -> Column:
    """Well-known text, with an optional ``SRID=n;`` prefix, through JSON: brackets for parentheses."""
    srid = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*SRID=(\d+);", 1), F.lit("")).cast("int"), F.lit(0))
    body = F.regexp_replace(text, r"^\s*SRID=\d+;", "")
    head = F.upper(F.trim(F.regexp_extract(body, r"^([^(]*)", 1)))
    kind = F.regexp_extract(head, r"^([A-Z]+?)(?: ?Z?M?)?(?: EMPTY)?$", 1)
    tag = F.regexp_extract(head, r"^[A-Z]+? ?(Z?M?)(?: EMPTY)?$", 1)
    numbers = F.regexp_replace(F.regexp_extract(body, r"(?s)(\(.*\))", 1), r"\s*([(),])\s*", "$1")
    points = F.regexp_replace(numbers, r"([^(),]+)", "[$1]")
    json = F.translate(F.regexp_replace(points, r"\s+", ","), "()", "[]")
    return F.when(text.isNotNull(), _from_nested(kind, json, tag.contains("Z"), tag.contains("M"), srid))


def from_geojson(text: Column) -> Column:
    """A GeoJSON geometry object."""
    kind = F.upper(F.get_json_object(text, "$.type"))
    coords = F.get_json_object(text, "$.coordinates")
    wrapped = F.when(kind == "POINT", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords)
    deep = F.regexp_extract(coords, r"(\[[^\[\]]*\])", 1)
    has_z = F.size(F.split(deep, ",")) > 2
    return F.when(text.isNotNull(), _from_nested(kind, wrapped, has_z, F.lit(False), F.lit(0)))


def _from_nested(kind: Column, json: Column, has_z: Column, has_m: Column, srid: Column) -> Column:
    flat = F.from_json(json, "array<array<double>>")
    # MULTIPOINT members may stand in their own parentheses.
    multipoint = F.when(json.startswith("[[["), F.from_json(F.regexp_replace(F.regexp_replace(json, r"\[\[\[", "[["), r"\]\],\[\[", "],["), "array<array<double>>")).otherwise(flat)
    lines = F.from_json(json, "array<array<array<double>>>")
    deep = F.from_json(json, PARTS)
    parts = (
        F.when(kind.isin("POINT", "LINESTRING"), F.array(F.array(flat)))
        .when(kind == "POLYGON", F.array(lines))
        .when(kind == "MULTIPOINT", F.transform(multipoint, lambda p: F.array(F.array(p))))
        .when(kind == "MULTILINESTRING", F.transform(lines, lambda ln: F.array(ln)))
        .when(kind == "MULTIPOLYGON", deep)
    )
    nothing = (json == "") | json.isNull()
    return _struct(kind, has_z, has_m, srid, F.when(nothing, F.array().cast(PARTS)).otherwise(parts))


def type_name(geom: Column) -> Column:
    """``POINT``, ``POINT Z``, ``POINT M`` or ``POINT ZM``."""
    tag = F.concat(F.when(geom["has_z"], "Z").otherwise(""), F.when(geom["has_m"], "M").otherwise(""))
    return F.when(tag == "", geom["kind"]).otherwise(F.concat(geom["kind"], F.lit(" "), tag))


def envelope(geom: Column) -> Column:
    """``minx, maxx, miny, maxy``; NULL for an empty geometry and for one that is not decoded."""
    return F.when(
        ~geom["empty"] & geom["raw"].isNull(),
        F.struct(geom["minx"].alias("minx"), geom["maxx"].alias("maxx"), geom["miny"].alias("miny"), geom["maxy"].alias("maxy")),
    )


def with_srid(geom: Column, srid: int) -> Column:
    return geom.withField("srid", F.lit(srid))


def promote(geom: Column) -> Column:
    """Lines and polygons as their multi kinds; the parts already have that shape."""
    kind = geom["kind"]
    return geom.withField("kind", F.when(kind.isin("LINESTRING", "POLYGON"), F.concat(F.lit("MULTI"), kind)).otherwise(kind))


def map_points(geom: Column, move: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The geometry with every x, y moved; other ordinates stay. The box is found anew.

    Kinds kept as bytes fail the job: leaving them where they are would be wrong silently.
    """

    def moved(p: Column) -> Column:
        x, y = move(p[0], p[1])
        return F.concat(F.array(x, y), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))

    parts = F.transform(geom["parts"], lambda m: F.transform(m, lambda r: F.transform(r, moved)))
    error = F.raise_error(F.concat(F.lit("points of this kind are not decoded and cannot be moved: "), geom["kind"]))
    return F.when(geom["raw"].isNotNull(), error).when(geom.isNotNull(), _struct(geom["kind"], geom["has_z"], geom["has_m"], geom["srid"], parts))


#: GeoJSON spellings of the kinds (fixed values).
GEOJSON_KINDS = {
    "POINT": "Point",
    "LINESTRING": "LineString",
    "POLYGON": "Polygon",
    "MULTIPOINT": "MultiPoint",
    "MULTILINESTRING": "MultiLineString",
    "MULTIPOLYGON": "MultiPolygon",
}


def to_geojson(geom: Column) -> Column:
    """GeoJSON text of a geometry; a kind kept as bytes fails the job, as it has no text here."""
    parts = geom["parts"]
    kind = geom["kind"]
    spelled = F.create_map(*[F.lit(v) for pair in GEOJSON_KINDS.items() for v in pair])
    coords = (
        F.when(geom["empty"], F.lit("[]"))
        .when(kind == "POINT", F.to_json(F.get(F.get(F.get(parts, F.lit(0)), F.lit(0)), F.lit(0))))
        .when(kind == "LINESTRING", F.to_json(F.get(F.get(parts, F.lit(0)), F.lit(0))))
        .when(kind == "POLYGON", F.to_json(F.get(parts, F.lit(0))))
        .when(kind == "MULTIPOINT", F.to_json(all_points(parts)))
        .when(kind == "MULTILINESTRING", F.to_json(F.flatten(parts)))
        .when(kind == "MULTIPOLYGON", F.to_json(parts))
    )
    text = F.concat(F.lit('{"type":"'), F.element_at(spelled, kind), F.lit('","coordinates":'), coords, F.lit("}"))
    error = F.raise_error(F.concat(F.lit("no GeoJSON of this kind: "), kind))
    return F.when(geom["raw"].isNotNull(), error).otherwise(text)
