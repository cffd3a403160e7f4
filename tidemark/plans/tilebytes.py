"""Tile files for queries and tests: LAS and TIFF headers made from rows."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def las(k: int, x: float, y: float, minor: int = 4, copc: bool = False) -> bytes:
    """A LAS header with ``k`` points in a 10 by 20 box at x, y."""
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24], head[25] = 1, minor
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<BHI", head, 104, (6 if minor >= 4 else 1) | (0x80 if k % 2 else 0), 30 if minor >= 4 else 28, k)
    struct.pack_into("<6d", head, 179, x + 10, x, y + 20, y, 5.0, 0.0)
    struct.pack_into("<Q", head, 247, k if minor >= 4 else 0)
    tail = bytes(2) + b"copc".ljust(16, b"\x00") if copc else b""
    return bytes(head) + tail + str(k).encode()


#: What writers of cloud-optimised files put behind the header (fixed value).
LAYOUT = b"GDAL_STRUCTURAL_METADATA_SIZE=000023 bytes\nLAYOUT=IFDS_BEFORE_DATA\n"


def tiff(width: int, height: int, x: float, y: float, tiled: bool = False, gap: int = 0, big: bool = False, order: str = "<") -> bytes:
    """A TIFF directory with size, pixel scale 1 and a tie point at x, y, behind ``gap`` bytes of pixels.

    A tiled one carries the mark of cloud-optimised files. ``big`` makes the 64-bit form.
    """
    mark = LAYOUT if tiled else b""
    at = (16 if big else 8) + len(mark) + gap
    tags = [(256, 3, 1, width), (257, 3, 1, height)]
    if tiled:
        tags.append((322, 3, 1, 256))
    count = len(tags) + 2
    data_at = at + (8 + 20 * count + 8 if big else 2 + 12 * count + 4)
    tags += [(33550, 12, 3, data_at), (33922, 12, 6, data_at + 24)]
    body = struct.pack(order + ("Q" if big else "H"), count)
    for tag, kind, n, value in tags:
        field = struct.pack(order + ("H" if kind == 3 else "Q" if big else "I"), value)
        body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, n) + field.ljust(8 if big else 4, b"\0")
    body += bytes(8 if big else 4) + struct.pack(order + "3d", 1.0, 1.0, 0.0) + struct.pack(order + "6d", 0, 0, 0, x, y, 0)
    name = b"II" if order == "<" else b"MM"
    head = name + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + mark + bytes(gap) + body


def tile_of(k: int, x: float, y: float) -> bytes:
    """The file of key ``k``: every fifth a raster, some with their directory behind 100 kB of pixels."""
    if k % 5 == 4:
        return tiff(k % 500 + 1, k % 300 + 1, x, y, k % 10 == 4, 100_000 if k % 20 == 9 else 0, k % 3 == 0, "<" if k % 4 else ">")
    return las(k, x, y, 4 if k % 3 else 2, k % 5 == 3)


#: A batch of files is handed on when it has so many bytes.
BATCH_BYTES = 1 << 22


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, made, size = 0, [], 0
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "x", "y"))), 1):
            made.append(tile_of(*row))
            size += len(made[-1])
            if size >= BATCH_BYTES or i == batch.num_rows:
                kept = [batch.column(c).slice(start, i - start) for c in ("k", "path")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], ["k", "path", "content"])
                start, made, size = i, [], 0


def tile_files(rows: DataFrame) -> DataFrame:
    """``k, path, content`` of rows of ``k, path, x, y``; batches are bounded in bytes, as files are read one at a time."""
    return rows.select("k", "path", "x", "y").mapInArrow(_made, f"k {rows.schema['k'].dataType.simpleString()}, path string, content binary")
