"""Bytes to geometry structs and back: the one place where IEEE doubles need Python.

Arrow batches in, Arrow batches out. Coordinates are read with numpy straight from the
bytes and laid out as one buffer per batch.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geometry import GEOMETRY, KINDS, OPAQUE

_CODES = {v: k for k, v in (KINDS | OPAQUE).items()}
_SINGLE = {4: 1, 5: 2, 6: 3}
#: Size of the box in a GeoPackage header by its indicator (fixed values).
_BOX_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}

_POINT = pa.list_(pa.float64())
_ARROW = pa.struct(
    [
        ("kind", pa.string()),
        ("has_z", pa.bool_()),
        ("has_m", pa.bool_()),
        ("srid", pa.int32()),
        ("empty", pa.bool_()),
        *[(n, pa.float64()) for n in ("minx", "miny", "maxx", "maxy", "minz", "maxz")],
        ("parts", pa.list_(pa.list_(pa.list_(_POINT)))),
        ("raw", pa.binary()),
    ]
)


def _header(data: bytes, at: int) -> tuple[str, int, bool, bool, int, int]:
    """Byte order, base kind, z, m, srid and where the body starts."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    srid = 0
    if code & 0x20000000:
        srid = struct.unpack_from(order + "I", data, at)[0]
        at += 4
    z, m = bool(code & 0x80000000), bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    thousand, base = divmod(code, 1000)
    return order, base, z or thousand in (1, 3), m or thousand in (2, 3), srid, at


def _coords(data: bytes, at: int, n: int, dims: int, order: str) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, dtype=order + "f8", count=n * dims, offset=at).astype("f8").reshape(n, dims)
    return out, at + 8 * n * dims


def _member(data: bytes, at: int, base: int, dims: int, order: str) -> tuple[list[np.ndarray], int]:
    """Rings of one single geometry."""
    if base == 1:
        pts, at = _coords(data, at, 1, dims, order)
        return ([] if np.isnan(pts[0, :2]).all() else [pts]), at
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    if base == 2:
        pts, at = _coords(data, at, n, dims, order)
        return ([pts] if n else []), at
    rings = []
    for _ in range(n):
        k = struct.unpack_from(order + "I", data, at)[0]
        pts, at = _coords(data, at + 4, k, dims, order)
        rings.append(pts)
    return rings, at


def parse(data: bytes) -> tuple | None:
    """``kind, z, m, srid, members, raw`` of WKB, EWKB or GeoPackage bytes; ``None`` if not one.

    Collections and curves keep their kind and their bytes, but have no members: they stay
    opaque. Bytes of no known kind are an error, so that nothing is taken for empty.
    """
    try:
        srid = 0
        at = 0
        if data[:2] == b"GP":
            flags = data[3]
            order = "<" if flags & 1 else ">"
            srid = struct.unpack_from(order + "i", data, 4)[0]
            at = 8 + _BOX_BYTES[(flags >> 1) & 7]
        start = at
        order, base, z, m, inner, at = _header(data, at)
        srid = inner or srid
        dims = 2 + z + m
        if base in (1, 2, 3):
            rings, _ = _member(data, at, base, dims, order)
            return KINDS[base], z, m, srid, [rings] if rings else [], None
        if base in _SINGLE:
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            members = []
            for _ in range(n):
                order, _, _, _, _, at = _header(data, at)
                rings, at = _member(data, at, _SINGLE[base], dims, order)
                members.append(rings)
            return KINDS[base], z, m, srid, members, None
        return OPAQUE[base], z, m, srid, None, data[start:]
    except (struct.error, ValueError, IndexError, KeyError):
        return None


def _lists(counts: list[int], values: pa.Array, nulls: list[bool] | None = None) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype="i4")
    np.cumsum(counts, out=offsets[1:])
    mask = pa.array(nulls, pa.bool_()) if nulls and any(nulls) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _elements(raw: bytes) -> int:
    """Members, points or rings that an opaque geometry says it has."""
    order, _, _, _, _, at = _header(raw, 0)
    return struct.unpack_from(order + "I", raw, at)[0]


def decode_batch(column: pa.Array) -> pa.Array:
    """Geometry structs of a batch, laid out as one coordinate buffer."""
    parsed = [None if v is None else parse(v) for v in column.to_pylist()]
    member_counts, ring_counts, point_counts, dims, coords = [], [], [], [], []
    boxes = np.full((len(parsed), 6), np.nan)
    empties = []
    for i, g in enumerate(parsed):
        members = (g[4] if g else None) or []
        member_counts.append(len(members))
        own = []
        for rings in members:
            ring_counts.append(len(rings))
            for r in rings:
                point_counts.append(len(r))
                dims.append(np.full(len(r), r.shape[1], dtype="i4"))
                coords.append(r.ravel())
                own.append(r)
        empties.append(not own if not g or g[5] is None else _elements(g[5]) == 0)
        if own:
            lows = np.min([np.nanmin(r, axis=0) for r in own], axis=0)
            highs = np.max([np.nanmax(r, axis=0) for r in own], axis=0)
            boxes[i, :4] = lows[0], lows[1], highs[0], highs[1]
            if g[1]:
                boxes[i, 4:] = lows[2], highs[2]
    flat = pa.array(np.concatenate(coords) if coords else np.empty(0), pa.float64())
    sizes = np.concatenate(dims) if dims else np.empty(0, "i4")
    points = _lists(list(sizes), flat)
    raws = [g[5] if g else None for g in parsed]
    parts = _lists(member_counts, _lists(ring_counts, _lists(point_counts, points)), [r is not None for r in raws])
    nulls = np.array([g is None for g in parsed], dtype=bool)
    fields = [
        pa.array([g[0] if g else None for g in parsed], pa.string()),
        pa.array([g[1] if g else None for g in parsed], pa.bool_()),
        pa.array([g[2] if g else None for g in parsed], pa.bool_()),
        pa.array([g[3] if g else None for g in parsed], pa.int32()),
        pa.array([e if g else None for e, g in zip(empties, parsed)], pa.bool_()),
        *[pa.array(boxes[:, j], pa.float64(), from_pandas=True) for j in range(6)],
        parts,
        pa.array(raws, pa.binary()),
    ]
    return pa.StructArray.from_arrays(fields, fields=list(_ARROW), mask=pa.array(nulls))


def encode_one(g: dict | None, srid: int | None = None) -> bytes | None:
    """Little-endian WKB of a geometry struct; EWKB when a ``srid`` is given."""
    if g is None:
        return None
    base = _CODES[g["kind"]]
    dims = 2 + bool(g["has_z"]) + bool(g["has_m"])
    extra = 1000 * bool(g["has_z"]) + 2000 * bool(g["has_m"])
    if srid is None:
        head = struct.pack("<BI", 1, base + extra)
    else:
        code = base | (0x80000000 if g["has_z"] else 0) | (0x40000000 if g["has_m"] else 0) | 0x20000000
        head = struct.pack("<BII", 1, code, srid)
    if g["raw"] is not None:  # the own header, the body as it came
        raw_order, *_, body = _header(g["raw"], 0)
        head = g["raw"][:1] + b"".join(struct.pack(raw_order + "I", x) for x in struct.unpack(f"<{len(head) // 4}I", head[1:]))
        return head + g["raw"][body:]
    parts = g["parts"] if g["parts"] is not None else []

    def ring(points) -> bytes:
        return struct.pack("<I", len(points)) + np.asarray([list(p) for p in points], dtype="<f8").tobytes()

    def single(kind: int, rings) -> bytes:
        if kind == 1:
            if not rings:
                return np.full(dims, np.nan, dtype="<f8").tobytes()
            return np.asarray(list(rings[0][0]), dtype="<f8").tobytes()
        if kind == 2:
            return ring(rings[0]) if rings else struct.pack("<I", 0)
        return struct.pack("<I", len(rings)) + b"".join(ring(r) for r in rings)

    if base in (1, 2, 3):
        return head + single(base, parts[0] if len(parts) else [])
    kind = _SINGLE[base]
    inner = struct.pack("<BI", 1, kind + extra)
    return head + struct.pack("<I", len(parts)) + b"".join(inner + single(kind, m) for m in parts)


def gpkg_one(g: dict | None) -> bytes | None:
    """GeoPackage bytes in the normal form: little-endian, srs 0, a box unless point or empty."""
    if g is None:
        return None
    wkb = encode_one(g)
    if g["empty"] or g["kind"] == "POINT" or g["raw"] is not None:
        return b"GP\x00" + bytes([0x11 if g["empty"] else 0x01]) + struct.pack("<i", 0) + wkb
    box = [g["minx"], g["maxx"], g["miny"], g["maxy"]] + ([g["minz"], g["maxz"]] if g["has_z"] else [])
    flags = 0x01 | ((2 if g["has_z"] else 1) << 1)
    return b"GP\x00" + bytes([flags]) + struct.pack("<i", 0) + struct.pack(f"<{len(box)}d", *box) + wkb


# Workers get this module's functions by value: a cluster needs no copy of the package.
# The functions become UDFs only when they are used, since declaring one needs a session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _encode_batch(column: pa.Array) -> pa.Array:
    return pa.array([encode_one(g) for g in column.to_pylist()], pa.binary())


def _encode_ewkb_batch(column: pa.Array) -> pa.Array:
    return pa.array([encode_one(g, g["srid"] if g else 0) for g in column.to_pylist()], pa.binary())


def _encode_gpkg_batch(column: pa.Array) -> pa.Array:
    return pa.array([gpkg_one(g) for g in column.to_pylist()], pa.binary())


def decode(column: Column) -> Column:
    """Geometry struct of WKB, EWKB or GeoPackage bytes; NULL for bytes that are neither."""
    return F.arrow_udf(decode_batch, GEOMETRY)(column)


def decode_hex(column: Column) -> Column:
    return decode(F.unhex(column))


def to_wkb(geom: Column) -> Column:
    return F.arrow_udf(_encode_batch, "binary")(geom)


def to_hex_wkb(geom: Column) -> Column:
    return F.hex(to_wkb(geom))


def to_ewkb(geom: Column) -> Column:
    return F.arrow_udf(_encode_ewkb_batch, "binary")(geom)


def to_gpkg(geom: Column) -> Column:
    """The stored form: equal geometries have equal bytes."""
    return F.arrow_udf(_encode_gpkg_batch, "binary")(geom)
