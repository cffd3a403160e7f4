"""Exact top-k search by inner product over an impact-ordered index.

A term is a coordinate; its postings are the rows of a shard in order of their value there,
cut into segments of one quantised value. A query visits segments of all terms by descending
impact, the size of its own weight times the segment's value, positive and negative ones
alike, and adds the quantised impact to the scores of the rows posted there, a score at a
time. What a row has not been given yet is at most the impact now reached for each of its
missing terms, and what it has been given is off by at most half a step a term: so every row
has a lower and an upper bound at any moment. Visits end when the bounds prove that few rows
can still be among the best, or when the postings end; those rows are scored exactly.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Rows of one index, and queries that meet it in one task.
SHARD_ROWS, BLOCK_QUERIES = 16384, 8192
#: Levels between a shard's least and largest value; a segment holds one level of one term.
LEVELS = 256
#: Impacts at which bounds are looked at, as shares of the largest one.
STOPS = (0.08, 0.025, 0.012, 0.0)
#: Share of a shard's rows that may be left to exact scoring.
LEFT = 0.1
#: What a posting adds beside its impact: row counters sit above this bit, scores stay below half of it.
COUNT = 40
LONG_MAX = 2**63 - 1


def whole(x: float) -> int:
    """floor(256 * x), also where the product leaves the range of doubles."""
    return floor(x * 256.0) if abs(x) < 2.0**900 else int(x) * 256


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole numbers of the vectors, short ones filled with 0; Python numbers if int64 could overflow."""
    flat = lists.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(pa.compute.list_value_length(flat).to_numpy(zero_copy_only=False)).astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    large = len(values) > 0 and float(np.abs(values).max()) >= 2.0**18
    out = np.zeros((len(flat), width), object if large else np.int64)
    rows = np.repeat(np.arange(len(flat)), lengths)
    cols = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
    out[rows, cols] = [whole(float(x)) for x in values] if large else np.floor(values * 256.0).astype(np.int64)
    return out


class ImpactIndex:
    """One shard: the order of its rows by the value of each term, and the quantised values."""

    def __init__(self, table: np.ndarray, levels: int = LEVELS):
        self.table = table
        low, high = int(table.min(initial=0)), int(table.max(initial=0))
        self.step = max(1, -(-(high - low) // levels))
        # The middle of a step stands for its values: off by at most half a step.
        middle = table // self.step * self.step + self.step // 2
        self.order = np.argsort(table, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(middle, self.order.T, axis=0).T.copy()
        self.visited = self.rescored = 0

    def best(self, query: np.ndarray, wanted: int, stops: tuple[float, ...] = STOPS, left: float = LEFT) -> tuple[np.ndarray, np.ndarray]:
        """Rows (at least ``wanted`` of the best, with all ties) and their exact scores."""
        n, terms = self.table.shape
        if n <= wanted or not terms:
            return np.arange(n), self.table @ query
        most = max(int(np.abs(self.values[:, 0] * query).max()), int(np.abs(self.values[:, -1] * query).max()))
        packed = np.zeros(n, np.int64)
        error = int(np.abs(query).sum()) * (self.step // 2)
        heads, tails = np.zeros(terms, np.int64), np.full(terms, n, np.int64)
        for stop in stops:
            limit = int(most * stop)
            for t in range(terms):
                weight = int(query[t])
                if weight == 0 and limit:
                    continue
                # Segments from either end of the list whose impact is above the limit.
                reach = limit // abs(weight) if weight else 0
                values, rows = self.values[t], self.order[t]
                head = int(np.searchsorted(values, -reach, side="left")) if limit else n
                tail = int(np.searchsorted(values, reach, side="right")) if limit else n
                for start, end in ((int(heads[t]), min(head, int(tails[t]))), (max(tail, int(heads[t])), int(tails[t]))):
                    if start < end:
                        posted = rows[start:end]
                        packed[posted] += values[start:end] * weight + (1 << COUNT)
                        self.visited += end - start
                heads[t], tails[t] = max(heads[t], head), min(tails[t], max(tail, head))
            count = (packed + (1 << COUNT - 1)) >> COUNT
            score = packed - (count << COUNT)
            # A term not yet given counts at most the limit; the error of steps is in any term.
            unsure = limit * (terms - count) + error
            least = np.partition(score - unsure, n - wanted)[n - wanted]
            possible = np.flatnonzero(score + unsure >= least)
            if limit == 0 or len(possible) <= max(wanted, left * n):
                break
        self.rescored += len(possible)
        return possible, self.table[possible] @ query


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, and no component NULL, infinite or NaN."""
    x = vector.cast("array<double>")
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & F.forall(x, good)


def search(
    vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, levels: int = LEVELS, left: float = LEFT
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` other rows of largest inner product for each row that meets ``queries``.

    Components are floor(256 * x). Ties go to the smaller id, NULL ids last. Every row is a
    candidate for every other one, also rows alike in id and vector; a row with a repeated id
    gets its own list. Vectors that are NULL or hold NULL or non-finite components take no
    part. Where lengths differ, what a vector lacks counts as 0. Scores beyond the range of
    long are exact while they are compared, and reported as its end. Fewer candidates than
    ``k`` give fewer rows; other columns are not looked at. Rows are dealt to shards by a
    written number and query rows meet each shard in blocks, so the work of a task is bounded.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = cut(rows.where(usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()))
    total, asked, width = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards, blocks = max(1, ceil(total / shard_rows)), max(1, ceil(asked / BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = rows.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", every(blocks))
    asking = rows.where("asks").select(F.col("row").alias("q"), F.col("v").alias("w"), F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", every(shards))

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "id": [], "row": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            ids, own = mine.column("id").to_pylist(), mine.column("row").to_numpy()
            table, asks = matrix(mine.column("v"), width), matrix(theirs.column("w"), width)
            largest = width * int(np.abs(table).max(initial=0)) * int(np.abs(asks).max(initial=0))
            index = ImpactIndex(table, levels) if 2 * largest < 1 << COUNT - 1 else None
            for q, vector in zip(theirs.column("q").to_numpy().tolist(), asks):
                if index is not None:
                    found, scores = index.best(vector, k + 1, left=left)
                else:  # too large for the counters: every row is a possible member
                    found, scores = np.arange(len(table)), table.astype(object) @ vector.astype(object)
                near = sorted((-int(s), ids[i] is None, ids[i] or 0, int(own[i]), int(i)) for i, s in zip(found, scores) if own[i] != q)
                for s, _, _, row, i in near[:k]:
                    out["q"].append(q), out["id"].append(ids[i]), out["row"].append(row), out["score"].append(str(-s))
        return pa.table(out, pa.schema([("q", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.string())]))

    met = mine.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(meet, "q bigint, id bigint, row bigint, score string")
    # Texts of whole numbers, ordered by sign, then by digits: long scores stay exact.
    minus, digits = F.col("score").startswith("-"), F.length("score")
    order = [minus.cast("int"), F.when(minus, digits).otherwise(-digits), F.when(minus, F.col("score")).asc_nulls_last(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = rows.where("asks").select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    limit = F.when(minus, F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    score = F.coalesce(F.expr("try_cast(score AS bigint)"), limit)
    return best.join(names, "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), score.alias("score"))
