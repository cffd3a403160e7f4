"""ISO 8601 text, offsets and stored forms of date and time values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    """Timestamp to ``YYYY-MM-DDThh:mm:ssZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso_utc(text: Column) -> Column:
    return F.to_timestamp(F.regexp_replace(text, "Z$", ""), "yyyy-MM-dd'T'HH:mm:ss")


def offset_text(minutes: Column, separator: str = ":") -> Column:
    """Minutes east of UTC to ``+HH:MM`` (or ``+HHMM`` with an empty separator)."""
    size = F.abs(minutes)
    return F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(separator),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def offset_minutes(text: Column) -> Column:
    """``+HH:MM`` or ``+HHMM`` to minutes east of UTC."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    size = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    return F.when(text.startswith("-"), -size).otherwise(size)


def stored_date(text: Column) -> Column:
    """``YYYY/MM/DD`` or ``YYYY-MM-DD`` from a file source to the stored form."""
    return F.regexp_replace(text, "/", "-")


def stored_timestamp(text: Column) -> Column:
    """``YYYY/MM/DD hh:mm:ss[.f][+00]`` from a file source to the stored form."""
    iso = F.regexp_replace(F.regexp_replace(text, "/", "-"), " ", "T")
    return F.regexp_replace(iso, r"\+00(:?00)?$", "Z")


def stored_numeric(value: Column, precision: int, scale: int) -> Column:
    """Decimals are kept as text without trailing zeros."""
    text = value.cast(f"decimal({precision},{scale})").cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def stored_boolean(value: Column) -> Column:
    return value.cast("boolean")
