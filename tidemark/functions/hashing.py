"""Content hashes and the text encodings built on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _columns(cols: Iterable[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def fingerprint(cols: Iterable[str | Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row.

    ``xxhash64`` skips NULL inputs, so each value travels with its null flag: otherwise
    ``(NULL, 'a')`` and ``('a', NULL)`` would be the same row.
    """
    parts: list[Column] = []
    for c in _columns(cols):
        parts += [c.isNull(), c]
    return F.xxhash64(*parts), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - (1 << 64)), *parts)


def content_id(cols: Iterable[str | Column]) -> Column:
    """160-bit hex id of a row's content, NULLs kept apart from empty text."""
    payload = F.to_json(F.struct(*_columns(cols)), {"ignoreNullFields": "false"})
    return hex_hash(payload)


def text_content_id(cols: Iterable[str | Column]) -> Column:
    """Content id over the text forms of the values.

    Each value is written as its length and text, NULL as ``-``, so the concatenation is
    unambiguous and equal on any engine that prints the values alike.
    """
    parts = []
    for c in _columns(cols):
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return hex_hash(F.concat_ws(",", *parts))


def hex_hash(value: Column) -> Column:
    """SHA-256 cut to 160 bits, as 40 hex digits."""
    return F.substring(F.sha2(value, 256), 1, 40)


def base64_hash(value: Column) -> Column:
    """SHA-256 cut to 160 bits, as URL-safe base64."""
    return url_base64(F.unhex(hex_hash(value)))


def uint32_hash(value: Column) -> Column:
    """First four bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("bigint")


def plain_base64(value: Column) -> Column:
    """Base64 on one line; Spark breaks long values into lines."""
    return F.translate(F.base64(value), "\r\n", "")


def url_base64(value: Column) -> Column:
    return F.translate(plain_base64(value), "+/", "-_")


def url_unbase64(value: Column) -> Column:
    return F.unbase64(F.translate(value, "-_", "+/"))
