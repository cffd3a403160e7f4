"""Tile files: headers of LAS point clouds and GeoTIFF rasters, read once per file.

Files come as Spark's ``binaryFile`` rows (``path, length, content``). Ids and sizes are
plain expressions; only the header needs Python, and it is asked for in Arrow batches of
the few bytes that are read of each file, so that a batch has no more of large files than of small ones.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tiles import corner_ring, format_summary, native_box, raster_format

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADER = (
    "struct<kind:string,version:string,compressed:boolean,copc:boolean,pdrf:int,record_length:int,points:bigint,"
    "native_extent:string,width:int,height:int,cog:boolean>"
)
_FIELDS = [
    ("kind", pa.string()), ("version", pa.string()), ("compressed", pa.bool_()), ("copc", pa.bool_()), ("pdrf", pa.int32()),
    ("record_length", pa.int32()), ("points", pa.int64()), ("native_extent", pa.string()), ("width", pa.int32()),
    ("height", pa.int32()), ("cog", pa.bool_()),
]


def las_header(data: bytes) -> dict | None:
    """Facts of a LAS or LAZ header; field positions are those of the public format."""
    if data[:4] != b"LASF" or len(data) < 227:
        return None
    major, minor = data[24], data[25]
    header_size = struct.unpack_from("<H", data, 94)[0]
    pdrf, length, legacy = struct.unpack_from("<BHI", data, 104)
    maxx, minx, maxy, miny, maxz, minz = struct.unpack_from("<6d", data, 179)
    points = legacy
    if minor >= 4 and len(data) >= 255:
        points = struct.unpack_from("<Q", data, 247)[0] or legacy
    first_vlr = data[header_size + 2 : header_size + 18].rstrip(b"\x00")
    extent = ",".join(repr(v) for v in (minx, maxx, miny, maxy, minz, maxz))
    return {
        "kind": "las", "version": f"{major}.{minor}", "compressed": bool(pdrf & 0x80), "copc": first_vlr == b"copc",
        "pdrf": pdrf & 0x3F, "record_length": length, "points": points, "native_extent": extent,
    }


class _Tiff:
    """Number forms of a TIFF: byte order and, for the large form, wider counts."""

    def __init__(self, head: bytes) -> None:
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        self.big = struct.unpack_from(self.order + "H", head, 2)[0] == 43
        self.entry, self.first = ("HHQ", 12) if self.big else ("HHI", 8)

    def tags(self, directory: bytes) -> dict[int, tuple[int, int, bytes]]:
        """Type, count and value field of each tag of a directory."""
        n = struct.unpack_from(self.order + ("Q" if self.big else "H"), directory, 0)[0]
        start, size = (8, 20) if self.big else (2, 12)
        out = {}
        for i in range(n):
            at = start + size * i
            tag, kind, count = struct.unpack_from(self.order + self.entry, directory, at)
            out[tag] = (kind, count, directory[at + self.first : at + size])
        return out

    def number(self, value: tuple[int, int, bytes]) -> int:
        form = {3: "H", 4: "I", 16: "Q"}[value[0]]
        return struct.unpack_from(self.order + form, value[2], 0)[0]


def tiff_layout(head: bytes, directory: bytes | None, marked: bool | None, scale: bytes | None, tie: bytes | None) -> dict | None:
    """Size, tiling and placement of the first image of a TIFF.

    ``cog`` is told by the layout mark that writers of cloud-optimised files put behind the
    header, on a tiled image. ``scale`` and ``tie`` are the values the directory points to; an
    image whose directory has both is only read if they are there.
    """
    if head[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+") or not directory:
        return None
    form = _Tiff(head)
    tags = form.tags(directory)
    out = {"kind": "geotiff", "width": form.number(tags[256]), "height": form.number(tags[257]), "cog": 322 in tags and bool(marked)}
    if SCALE in tags and TIE in tags:
        out["native_extent"] = tiff_extent(form.order, out["width"], out["height"], scale or b"", tie or b"")
    return out


def tiff_extent(order: str, width: int, height: int, scale: bytes, tie: bytes) -> str:
    """The ring of an image from its pixel scale and tie point."""
    sx, sy = struct.unpack_from(order + "2d", scale, 0)
    i, j, _, x, y = struct.unpack_from(order + "5d", tie, 0)
    x0, y1 = x - i * sx, y + j * sy
    x1, y0 = x0 + width * sx, y1 - height * sy
    return f"POLYGON(({x0!r} {y1!r},{x0!r} {y0!r},{x1!r} {y0!r},{x1!r} {y1!r},{x0!r} {y1!r}))"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for head, *pieces in zip(*(batch.column(c).to_pylist() for c in ("head", "directory", "marked", "scale", "tie"))):
            row = None
            if head is not None:
                try:
                    row = las_header(head) or tiff_layout(head, *pieces)
                except (struct.error, KeyError, IndexError):
                    row = None
            rows.append(row)
        kept = [batch.column(c) for c in ("path", "oid", "size")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.struct(_FIELDS))], ["path", "oid", "size", "h"])


def _unsigned(content: Column, at: Column | int, size: int, little: Column) -> Column:
    """An unsigned number of ``size`` bytes at a place of the content, in either byte order."""
    start = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, (start + 1).cast("int"), F.lit(size)))
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(F.when(little, turned).otherwise(digits), 16, 10).cast("bigint")


def tiff_directory(content: Column) -> Column:
    """The first directory of a TIFF, wherever in the file it is; NULL for other files.

    Its place is in the header and its length at its start, so just these bytes are cut out.
    """
    little = F.substring(content, 1, 2) == F.lit(b"II")
    magic = _unsigned(content, 2, 2, little)

    def cut_out(at: Column, count: int, entry: int) -> Column:
        n = _unsigned(content, at, count, little)
        return F.substring(content, (at + 1).cast("int"), (n * entry + count).cast("int"))

    tiff = little | (F.substring(content, 1, 2) == F.lit(b"MM"))
    return F.when(tiff & (magic == 42), cut_out(_unsigned(content, 4, 4, little), 2, 12)).when(tiff & (magic == 43), cut_out(_unsigned(content, 8, 8, little), 8, 20))


def _placed_at(directory: Column, little: Column, big: Column, tag: int) -> Column:
    """Where a directory says that the value of a tag is, by the tag's last entry; NULL without one."""
    first, step = F.when(big, 8).otherwise(2), F.when(big, 20).otherwise(12)
    entries = F.floor((F.octet_length(directory) - first) / step).cast("int")
    name = F.when(little, F.lit(tag.to_bytes(2, "little"))).otherwise(F.lit(tag.to_bytes(2, "big")))
    having = F.filter(F.when(entries > 0, F.sequence(F.lit(0), entries - 1)), lambda i: F.substring(directory, first + i * step + 1, F.lit(2)) == name)
    at = first + F.array_max(having) * step
    return F.when(big, _unsigned(directory, at + 12, 8, little)).otherwise(_unsigned(directory, at + 8, 4, little))


#: Tags of the pixel scale and the tie point of an image.
SCALE, TIE = 33550, 33922
#: The layout mark of cloud-optimised files, and what takes it back, are looked for up to here.
HEAD_BYTES = (1 << 16) + 64
LAYOUT, BROKEN_LAYOUT = b"LAYOUT=IFDS_BEFORE_DATA", b"KNOWN_INCOMPATIBLE_EDITION=YES"


def pieces(files: DataFrame) -> DataFrame:
    """Path, id and size of every file and the bytes that header readers need, cut out at their own places.

    Of a LAS file these are the header and the name of the record behind it; of a TIFF the
    header, whether the layout mark follows, the directory, and pixel scale and tie point,
    wherever they are. Contents go no further than this.
    """
    content = F.col("content")
    little = F.substring(content, 1, 2) == F.lit(b"II")
    rows = files.select("path", "content", little.alias("little"), (_unsigned(content, 2, 2, little) == 43).alias("big"), tiff_directory(content).alias("directory"))
    places = [_placed_at(F.col("directory"), F.col("little"), F.col("big"), tag).alias(name) for name, tag in (("scale_at", SCALE), ("tie_at", TIE))]
    rows = rows.select("*", *places)
    las = F.substring(content, 1, 4) == F.lit(b"LASF")
    head = F.when(las, F.substring(content, F.lit(1), F.greatest(F.lit(255), _unsigned(content, 94, 2, F.lit(True)).cast("int") + 18))).otherwise(F.substring(content, 1, 16))
    mark = F.when(F.col("big"), F.substring(content, 17, HEAD_BYTES - 16)).otherwise(F.substring(content, 9, HEAD_BYTES - 8))
    marked = F.contains(mark, F.lit(LAYOUT)) & ~F.contains(mark, F.lit(BROKEN_LAYOUT))
    values = [
        F.when(F.col(at) < F.octet_length(content), F.substring(content, (F.col(at) + 1).cast("int"), F.lit(n))).alias(name)
        for name, at, n in (("scale", "scale_at", 16), ("tie", "tie_at", 40))
    ]
    return rows.select(
        "path",
        F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("oid"),
        F.octet_length(content).cast("bigint").alias("size"),
        head.alias("head"),
        "directory",
        F.when(F.col("directory").isNotNull(), marked).alias("marked"),
        *values,
    )


def catalogue(files: DataFrame, crs: str = "EPSG:4326", url: bool = False) -> DataFrame:
    """One summary row per tile file. With ``url`` the path is kept and the file stays where it is.

    The id is taken from the whole content. The header readers are given the pieces of a file
    that they need, once, so that whole tiles neither travel to Python nor wait for it. A file
    that is no tile fails the job by name.
    """
    error = F.raise_error(F.concat(F.lit("not a readable tile file: "), F.col("path")))
    read_rows = pieces(files).mapInArrow(_headers, f"path string, oid string, size bigint, h {HEADER}")
    rows = read_rows.withColumn("_error", F.when(F.col("h").isNull(), error).cast("string")).filter(F.col("_error").isNull()).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "oid", "size", "h", *([F.col("path").alias("url")] if url else [])
    )
    las = F.col("h.kind") == "las"
    fmt = F.when(
        las,
        format_summary(
            F.when(F.col("h.compressed"), "laz").otherwise("las"), F.col("h.version"), F.when(F.col("h.copc"), F.lit("copc")), F.lit("1.0")
        ),
    ).when(F.col("h.kind") == "geotiff", raster_format(F.coalesce("h.cog", F.lit(False))))
    box = native_box(F.col("h.native_extent"))
    return rows.select(
        "name",
        fmt.alias("format"),
        F.when(F.col("h.native_extent").isNotNull(), corner_ring(box, crs)).alias("crs84_extent"),
        F.when(F.col("h.width").isNotNull(), F.concat_ws("x", "h.width", "h.height")).alias("dimensions"),
        F.col("h.native_extent").alias("native_extent"),
        F.col("h.points").alias("point_count"),
        F.col("h.pdrf").alias("pdrf"),
        F.col("h.record_length").alias("record_length"),
        "oid",
        "size",
        *(["url"] if url else []),
    )


def read(spark: SparkSession, path: str, pattern: str = "*", crs: str = "EPSG:4326", url: bool = False) -> DataFrame:
    """Catalogue of a folder or bucket prefix; ``pattern`` is a file name glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return catalogue(files, crs, url)
