"""Orders of deltas, conflicts and commits, and the limits built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta_order(key: str, kind: str) -> list[Column]:
    """Null key first, then numbers by value, then text."""
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [F.col(key).isNotNull().asc(), F.lit(not numeric).asc(), F.col(key).asc_nulls_first()]


def mixed_order(number: str, text: str) -> list[Column]:
    """Order of keys of which some are numbers and some text: null, numbers, text."""
    return [
        (F.col(number).isNotNull() | F.col(text).isNotNull()).asc(),
        F.col(text).isNotNull().asc(),
        F.col(number).asc_nulls_first(),
        F.col(text).asc_nulls_first(),
    ]


def conflict_order(dataset: str, part: str, key: str) -> list[Column]:
    """Meta before features; numeric keys by value before text; compound keys last."""
    digits = F.col(key).rlike("^[0-9]+$")
    return [
        F.col(dataset).asc(),
        F.when(F.col(part) == "meta", 0).when(F.col(part) == "feature", 1).otherwise(2).asc(),
        F.col(key).contains(",").asc(),
        digits.desc(),
        F.when(digits, F.col(key)).try_cast("decimal(38,0)").asc_nulls_last(),
        F.col(key).asc(),
    ]


def conflict_rank_columns(part: str, key: str) -> dict[str, Column]:
    """The parts of :func:`conflict_order` as plain columns."""
    digits = F.col(key).rlike("^[0-9]+$")
    return {
        "part_rank": F.when(F.col(part) == "meta", 0).when(F.col(part) == "feature", 1).otherwise(2),
        "key_rank": F.when(F.col(key).contains(","), 2).when(digits, 0).otherwise(1),
        "key_number": F.when(digits, F.col(key)).try_cast("bigint"),
    }


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of a source; Spark keeps the best ``n`` per task, then merges."""
    return df.orderBy(*order).limit(n)


def log_window(commits: DataFrame, skip: int = 0, max_count: int | None = None) -> DataFrame:
    """Newest commits first, after ``skip``, at most ``max_count`` (a report the user asks for)."""
    out = commits.orderBy(F.col("commit_time").desc(), F.col("commit_id").desc())
    if skip:
        out = out.offset(skip)
    return out if max_count is None else out.limit(max_count)


def insert_budget(limit: int, old_count: Column, new_count: Column) -> Column:
    """How many inserts a similarity search may hold: half of the work limit less the growth."""
    return F.floor(F.greatest(F.lit(limit) + (new_count - old_count), F.lit(0)) / 2).cast("bigint")
