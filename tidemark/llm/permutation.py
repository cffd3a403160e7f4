"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a few pivots. Rows are dealt to shards
by hash; each shard posts its rows in one inverted file per pivot, with the place the pivot
takes in the row's order. A query adds up footrule distances over the files of its own
nearest pivots, and the rows that come out nearest are ranked again by the exact cosine.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Pivots: those vectors whose hashes are least. A bounded sample; every row is indexed.
PIVOTS = 256
#: Nearest pivots a row is posted under, and those a query looks up.
POSTED, ASKED = 128, 64
#: Share of a shard's rows that is ranked again, and the least number of them.
SHARE, LEAST_RANKED = 0.08, 400
#: Rows of a shard and queries of a block that meet in one task.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 16_384


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: v as doubles, of the most frequent length."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (lengths.d if lengths else 0))


def orders(units: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Per row its ``depth`` nearest pivots, nearest first."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int32)


class Shard:
    """The rows of one shard, posted under their pivots."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, posted: int) -> None:
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.depth = min(posted, len(pivots))
        seen = orders(vectors / self.norms[:, None], pivots, self.depth).ravel()
        by_pivot = np.argsort(seen, kind="stable")
        self.rows, self.places = (by_pivot // self.depth).astype(np.int32), (by_pivot % self.depth).astype(np.int32)
        self.begins = np.searchsorted(seen[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of every row from a query's pivot order; a pivot a row is not posted under counts as its last place."""
        out = np.full(len(self.vectors), int((self.depth - np.arange(len(order))).sum()), dtype=np.int32)
        for place, pivot in enumerate(order.tolist()):
            file = slice(self.begins[pivot], self.begins[pivot + 1])
            out[self.rows[file]] += np.abs(self.places[file] - place) - (self.depth - place)
        return out

    def nearest(self, order: np.ndarray, vector: np.ndarray, norm: float, ranked: int, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of the ``ranked`` rows nearest by footrule: their numbers and cosines, ties to the smaller name."""
        if ranked < len(self.vectors):
            rows = np.argpartition(self.footrule(order), ranked - 1)[:ranked]
        else:
            rows = np.arange(len(self.vectors))
        cosine = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
        best = np.lexsort((names[rows], -cosine))[:k]
        return rows[best], cosine[best]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component: cosines stay bit for bit, squares stay finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return scaled(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))


def search(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, posted: int = POSTED, asked: int = ASKED, share: float = SHARE, least_ranked: int = LEAST_RANKED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id in ``queries`` its ``k`` nearest other vectors by cosine.

    Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do
    those of another length than the most frequent one or without id. Equal vectors are one
    row of the index with their ``k`` + 1 smallest ids, so copies, however many, are searched
    once and found exactly; rows alike in id and vector are one. Rows that share an id but not
    the vector are rows of their own: each asks for itself, and each can be found, also by the
    other. Ties go to the smaller id. Fewer candidates than ``k`` give fewer rows; no vectors
    give none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).groupBy("v", "id").agg(F.lit(1).alias("one")).select("v", "id")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    # Names are row numbers; they are fixed by being written.
    same = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("name"), "ids", "v"))
    wanted = usable(vectors, id_col, vector_col).join(queries.select(F.col(queries.columns[0]).cast("bigint").alias("q")).distinct(), F.col("id") == F.col("q"), "left_semi").distinct()
    asking = cut(wanted.join(same.select("name", F.col("v").alias("w")), F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), "name", "v"))
    total, asked_total = same.count(), asking.select("name").distinct().count()
    chosen = [r.v for r in same.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(pivots).select("v").collect()]
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    table = scaled(np.array(chosen))
    sent = spark.sparkContext.broadcast(table / np.sqrt((table * table).sum(axis=1))[:, None])
    shards, blocks = max(1, ceil(total / SHARD_ROWS)), max(1, ceil(asked_total / BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = same.select("name", F.col("ids")[0].alias("least"), "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", every(blocks))
    right = asking.select("name", "v").dropDuplicates(["name"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "name"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if mine.num_rows and theirs.num_rows:
            names, least = mine.column("name").to_numpy(), mine.column("least").to_numpy()
            shard = Shard(_matrix(mine.column("v")), sent.value, posted)
            asks = _matrix(theirs.column("v"))
            norms = np.sqrt((asks * asks).sum(axis=1))
            seen = orders(asks / norms[:, None], sent.value, min(asked, shard.depth))
            ranked = max(least_ranked, ceil(share * len(names)))
            for i, q in enumerate(theirs.column("name").to_numpy()):
                best, cosine = shard.nearest(seen[i], asks[i], norms[i], ranked, k + 1, least)
                found.append((np.full(len(best), q), names[best], least[best], cosine))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        columns = {"q": pa.int64(), "name": pa.int64(), "least": pa.int64(), "score": pa.float64()}
        return pa.table({name: pa.array(part, kind) for part, (name, kind) in zip(parts, columns.items())})

    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "q bigint, name bigint, least bigint, score double")
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k + 1)
    spread = best.join(same.select("name", "ids"), "name").select("q", "name", "score", F.explode("ids").alias("vec_id"))
    listed = spread.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", F.col("name").alias("of")))).alias("near"))
    out = asking.join(listed, F.col("name") == F.col("q"))
    others = F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["of"] != F.col("name")))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
