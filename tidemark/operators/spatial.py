"""Area filters on rows and deltas, and the box index over history."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import envelopes, geometry
from tidemark.functions.crs import reproject_xy
from tidemark.functions.geometry import GEOMETRY, empty, from_wkt, point  # noqa: F401
from tidemark.operators.diffing import WORKSPACE_EDIT

Ring = Sequence[tuple[float, float]]

EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def _overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.when(b1 < a1, b2 > a1).when(a1 < b1, a2 > b1).otherwise((b2 != b1) & (a2 != a1))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Boxes that only touch do not overlap; nor does one of no width with an equal left edge."""
    return _overlaps(a["minx"], a["maxx"], b["minx"], b["maxx"]) & _overlaps(a["miny"], a["maxy"], b["miny"], b["maxy"])


def has_shape(geom: Column) -> Column:
    return geom.isNotNull() & ~geom["empty"]


class Area:
    """A polygon or multipolygon (polygons -> rings -> points) as literals of a plan.

    Its size is that of the user's polygon. Rows are first held against its box with
    plain comparisons on box columns, and only the survivors against its edges.
    """

    def __init__(self, polygons: Sequence[Sequence[Ring]], crs: str = "EPSG:4326"):
        self.polygons = [[list(map(tuple, r)) for r in p] for p in polygons]
        self.crs = crs
        points = [pt for p in self.polygons for r in p for pt in r]
        if not points:
            raise ValueError("an area must not be empty")
        self.bounds = (
            min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)
        )
        edges = [
            {"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]}
            for p in self.polygons for r in p for a, b in zip(r, r[1:])
        ]
        # One literal of JSON text: the optimiser folds it once, however many edges.
        self.edges = F.from_json(F.lit(json.dumps(edges)), EDGES)
        #: A corner of every part: a part may lie inside a row's polygon without touching its edges.
        self.corners = [p[0][0] for p in self.polygons]

    @classmethod
    def parse(cls, spec: str, spark) -> Area | None:
        """``CRS;WKT``, ``CRS;hex WKB`` or the same with a blank line between; ``none`` clears."""
        text = spec.strip()
        if text.lower() == "none":
            return None
        crs, _, shape = (text.partition("\n\n") if "\n\n" in text else text.partition(";"))
        crs, shape = crs.strip(), shape.strip()
        if not shape:
            raise ValueError("an area needs a reference system and a geometry")
        if all(c in "0123456789abcdefABCDEF" for c in shape):
            from tidemark.functions.wkb import parse

            parsed = parse(bytes.fromhex(shape))
            if parsed is None:
                raise ValueError("not a geometry")
            kind, members = parsed[0], [[[tuple(p[:2]) for p in r] for r in m] for m in parsed[4] or []]
        else:
            row = spark.range(1).select(geometry.from_wkt(F.lit(shape)).alias("g")).first().g
            kind, members = row.kind, [[[tuple(p[:2]) for p in r] for r in m] for m in row.parts or []]
        if kind not in ("POLYGON", "MULTIPOLYGON") or not members:
            raise ValueError("an area must be a polygon that is not empty")
        return cls(members, crs)

    def to_crs(self, target: str, spark) -> Area:
        """The same area in another system."""
        points = [(i, j, k, float(x), float(y)) for i, p in enumerate(self.polygons) for j, r in enumerate(p) for k, (x, y) in enumerate(r)]
        df = spark.createDataFrame(points, "i int, j int, k int, x double, y double")
        x, y = reproject_xy(self.crs, target, F.col("x"), F.col("y"))
        polygons: list = [[[] for _ in p] for p in self.polygons]
        for row in df.select("i", "j", "k", x.alias("x"), y.alias("y")).orderBy("i", "j", "k").collect():
            polygons[row.i][row.j].append((row.x, row.y))
        return Area(polygons, target)

    def within(self, w: float, s: float, e: float, n: float) -> bool:
        """Is the area's box inside a given box."""
        x0, y0, x1, y1 = self.bounds
        return x0 >= w and y0 >= s and x1 <= e and y1 <= n

    def box_test(self, geom: Column) -> Column:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in self.bounds)
        return boxes_overlap(box(x0, y0, x1, y1), geom)

    def contains(self, x: Column, y: Column) -> Column:
        """Even-odd rule; points on an edge are in."""
        crossings = F.aggregate(
            self.edges,
            F.lit(0),
            lambda n, e: n
            + F.when(
                ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
                1,
            ).otherwise(0),
        )
        on_edge = F.exists(
            self.edges,
            lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
        )
        return (crossings % 2 == 1) | on_edge

    def _crosses(self, geom: Column) -> Column:
        """Any edge of a line or polygon that meets an edge of the area."""

        def side(ax, ay, bx, by, px, py):
            return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

        def ring_hits(ring: Column) -> Column:
            segments = F.zip_with(
                F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
                F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
                lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")),
            )

            def hit(s: Column) -> Column:
                def meets(e: Column) -> Column:
                    d1 = side(e["x1"], e["y1"], e["x2"], e["y2"], s["ax"], s["ay"])
                    d2 = side(e["x1"], e["y1"], e["x2"], e["y2"], s["bx"], s["by"])
                    d3 = side(s["ax"], s["ay"], s["bx"], s["by"], e["x1"], e["y1"])
                    d4 = side(s["ax"], s["ay"], s["bx"], s["by"], e["x2"], e["y2"])
                    apart = (
                        (F.greatest(s["ax"], s["bx"]) < F.least(e["x1"], e["x2"]))
                        | (F.least(s["ax"], s["bx"]) > F.greatest(e["x1"], e["x2"]))
                        | (F.greatest(s["ay"], s["by"]) < F.least(e["y1"], e["y2"]))
                        | (F.least(s["ay"], s["by"]) > F.greatest(e["y1"], e["y2"]))
                    )
                    return ~apart & (d1 * d2 <= 0) & (d3 * d4 <= 0)

                return F.exists(self.edges, meets)

            return F.exists(segments, hit)

        return F.exists(F.flatten(geom["parts"]), ring_hits)

    def _surrounded(self, geom: Column) -> Column:
        """A corner of any part of the area inside a polygon of the row."""
        corners = F.from_json(F.lit(json.dumps([{"x": float(x), "y": float(y)} for x, y in self.corners])), "array<struct<x:double,y:double>>")
        return F.exists(corners, lambda c: self._holds(geom, c["x"], c["y"]))

    @staticmethod
    def _holds(geom: Column, cx: Column, cy: Column) -> Column:
        """A point inside a polygon of the row, by the even-odd rule."""

        def crossings(ring: Column) -> Column:
            segments = F.zip_with(
                F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
                F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
                lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")),
            )
            return F.aggregate(
                segments,
                F.lit(0),
                lambda n, s: n
                + F.when(
                    ((s["ay"] > cy) != (s["by"] > cy))
                    & (cx < (s["bx"] - s["ax"]) * (cy - s["ay"]) / (s["by"] - s["ay"]) + s["ax"]),
                    1,
                ).otherwise(0),
            )

        total = F.aggregate(F.flatten(geom["parts"]), F.lit(0), lambda n, r: n + crossings(r))
        return geom["kind"].isin("POLYGON", "MULTIPOLYGON") & (total % 2 == 1)

    def intersects(self, geom: Column) -> Column:
        """Exact test of a geometry against the area."""
        is_point = geom["kind"] == "POINT"
        any_vertex = F.exists(geometry.all_points(geom["parts"]), lambda p: self.contains(p[0], p[1]))
        return F.when(is_point, self.contains(geom["minx"], geom["miny"])).otherwise(
            any_vertex | self._crosses(geom) | self._surrounded(geom)
        )

    def matches(self, geom: Column) -> Column:
        """Filter on rows: no geometry matches, an undecoded one matches, else box then exact test."""
        opaque = geom["parts"].isNull()
        exact = F.when(self.box_test(geom), self.intersects(geom)).otherwise(False)
        return F.when(geom.isNull() | geom["empty"] | opaque, F.lit(True)).otherwise(exact)

    def state(self, exists: Column, geom: Column) -> Column:
        return F.when(~exists, "NONEXISTENT").when(self.matches(geom), "MATCHING").otherwise("NON_MATCHING")


def _half(delta_half: str, area: Area, geom: str) -> Column:
    return F.col(delta_half).isNotNull() & area.matches(F.col(delta_half)[geom])


def filter_deltas(delta: DataFrame, area: Area, geom: str, new_area: Area | None = None) -> DataFrame:
    """Deltas of which either half matches, and all workspace edits.

    Each half is held against the area in its own reference system.
    """
    edit = F.col("flags").bitwiseAND(F.lit(WORKSPACE_EDIT)) != 0
    return delta.filter(edit | _half("old", area, geom) | _half("new", new_area or area, geom))


def key_clashes(delta: DataFrame, area: Area, geom: str) -> DataFrame:
    """Apparent edits of rows that lie outside the filter: a key taken twice."""
    return delta.filter(F.col("old").isNotNull() & F.col("new").isNotNull() & ~_half("old", area, geom))


def now_outside(delta: DataFrame, area: Area, geom: str) -> DataFrame:
    return delta.filter(F.col("new").isNotNull() & ~_half("new", area, geom)).select(F.col("new_key").alias("key"))


def left_out(delta: DataFrame, area: Area, geom: str, dataset: str) -> DataFrame:
    """How many deltas have neither half in the filter."""
    out = delta.filter(~_half("old", area, geom) & ~_half("new", area, geom))
    return out.groupBy(F.lit(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


def reproject(geom: Column, source: str, target: str, key: Column) -> Column:
    """Geometry in another system; a point that has no image fails the job and names the key."""
    message = F.concat(F.lit(f"cannot reproject from {source} to {target}: row "), key.cast("string"))

    def checked(moved: Column) -> Column:
        bad = F.exists(
            geometry.all_points(moved["parts"]), lambda p: F.isnan(p[0]) | F.isnan(p[1]) | p[0].isNull() | p[1].isNull()
        )
        return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast(GEOMETRY)).otherwise(moved)

    return geometry.let(geometry.map_points(geom, lambda x, y: reproject_xy(source, target, x, y)), checked)


# -- box index ------------------------------------------------------------------------


def index_entries(objects: DataFrame, crs_column: str = "crs", geom: str = "geom", known: Sequence[str] = ("EPSG:4326",)) -> DataFrame:
    """``oid, box`` of every object: the union of its boxes under all systems it may be in.

    ``objects`` has one row per object and applicable system. A box in a plainly wrong system
    is skipped if others remain; any other failure, and a system that is not among
    ``known``, leaves the object out of the index: its box would be too small.
    """
    g = F.col(geom)
    boxes = None
    for crs in known:
        b = envelopes.project_box(crs, g["minx"], g["miny"], g["maxx"], g["maxy"])
        boxes = F.when(F.col(crs_column) == crs, b) if boxes is None else boxes.when(F.col(crs_column) == crs, b)
    rows = objects.filter(has_shape(g)).withColumn("_b", boxes)
    per_object = rows.groupBy("oid").agg(
        F.collect_set(F.when(F.col("_b.problem").isNull(), F.struct("_b.w", "_b.s", "_b.e", "_b.n"))).alias("_boxes"),
        F.max((F.col("_b").isNull() | F.coalesce(F.col("_b.problem") == "unclear", F.lit(False))).cast("int")).alias("_unclear"),
    )
    united = per_object.filter(F.coalesce("_unclear", F.lit(0)) == 0).withColumn(
        "box", envelopes.union_all(F.array_sort(F.col("_boxes")).cast(f"array<{envelopes.BOX}>"))
    )
    return united.filter(F.col("box").isNotNull() & envelopes.valid_box(F.col("box"))).select("oid", "box")


def index_new(objects: DataFrame, index: DataFrame, **options) -> DataFrame:
    """Entries for objects the index does not have; running it again adds nothing."""
    return index_entries(objects.join(index.select("oid"), "oid", "left_anti"), **options)


def query_index(rows: DataFrame, index: DataFrame, area_box: tuple[float, float, float, float]) -> DataFrame:
    """Rows that may lie in a box; rows without an entry are kept."""
    w, s, e, n = (F.lit(float(v)) for v in area_box)
    joined = rows.join(index.select("oid", "box"), "oid", "left")
    hit = F.col("box").isNull() | envelopes.boxes_meet(F.col("box"), envelopes.lonlat_box(w, s, e, n))
    return joined.filter(hit).drop("box")


#: Pieces of a degree that west edges are sorted in.
EXTENT_CELLS = 64


def extent_by(rows: DataFrame, by: Sequence[str], box_column: str = "box") -> DataFrame:
    """Narrowest box around all boxes of a group, the antimeridian included.

    The box starts where the widest stretch without any box ends. Boxes are sorted by their
    west edge inside cells of a fraction of a degree, never a whole group in one task; how
    far east earlier cells reach is a window over at most ``360 * EXTENT_CELLS`` rows per group.
    """
    b = F.col(box_column)
    west = envelopes.wrap_lon(b["w"])
    flat = rows.select(*by, west.alias("_w"), (west + (envelopes.unwrap_east(b["w"], b["e"]) - b["w"])).alias("_e"), b["s"].alias("_s"), b["n"].alias("_n"))
    flat = flat.withColumn("_c", F.floor((F.col("_w") + 180) * EXTENT_CELLS).cast("int"))
    cells = flat.groupBy(*by, "_c").agg(F.max("_e").alias("_e"), F.min("_s").alias("_s"), F.max("_n").alias("_n"))
    group = W.partitionBy(*by)
    before = group.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    # What lies furthest east also lies 360 degrees before the first box.
    cells = cells.select(
        *by, "_c", F.greatest(F.max("_e").over(before), F.max("_e").over(group) - 360).alias("_reach"),
        F.min("_s").over(group).alias("s"), F.max("_n").over(group).alias("n"),
    )
    inside = W.partitionBy(*by, "_c").orderBy("_w").rowsBetween(W.unboundedPreceding, -1)
    met = flat.select(*by, "_c", "_w", F.max("_e").over(inside).alias("_own")).join(cells, [*by, "_c"])
    gap = F.col("_w") - F.greatest("_own", "_reach")
    widest = met.groupBy(*by).agg(F.max(F.struct(gap.alias("gap"), (-F.col("_w")).alias("west"))).alias("_k"), F.first("s").alias("s"), F.first("n").alias("n"))
    start = -F.col("_k.west")
    around = F.col("_k.gap") <= 0
    ww, ee = envelopes.wrap_edges(start, start + 360 - F.col("_k.gap"))
    return widest.select(
        *by,
        F.when(around, F.lit(-180.0)).otherwise(ww).alias("w"), "s",
        F.when(around, F.lit(180.0)).otherwise(ee).alias("e"), "n",
    )
