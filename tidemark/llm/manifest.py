"""Merkle manifest of a dataset, with a witness for every row.

Rows of a group (a language) are the leaves of a tree with runs of eight; the roots of the
groups are the leaves of one more tree. A tree is built by appends: a digest joins the open
run of the lowest level, a full run is hashed and appended to the level above. Whoever waits
in an open subtree carries a partial witness; when the run above its subtree ends, the
witness is extended by the digests beside it. A task appends aligned blocks of leaves and
hands on one root per block; those roots are appended in the same way, until each tree has
one. The witnesses of block roots then come down and extend those of the rows below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Children of a node.
FANOUT = 8
#: Levels of a tree that one block spans: a block has ``FANOUT ** BLOCK_LEVELS`` leaves.
BLOCK_LEVELS = 4
#: Rows numbered in one task.
PART_ROWS = 1 << 18
#: Length of a digest in hex.
HEX = 64
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: each value as ``-`` if NULL, else its UTF-8 byte count, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Appender:
    """Append of the leaves of one aligned block.

    ``open[l]`` holds the digests of the open run of level ``l``, and ``under[l]`` the leaves
    below each of them, as index ranges. ``sides[i]`` is the witness of leaf ``i`` so far, one text of
    joined sibling digests per level, and ``turns[i]`` its place in each run.
    """

    def __init__(self, levels: int, fanout: int = FANOUT):
        self.levels, self.fanout = levels, fanout
        self.open: list[list[str]] = [[] for _ in range(levels + 1)]
        self.under: list[list[tuple[int, int]]] = [[] for _ in range(levels + 1)]
        self.sides: list[list[str]] = []
        self.turns: list[list[int]] = []

    def append(self, leaf: str) -> None:
        at = len(self.sides)
        self.sides.append([])
        self.turns.append([])
        self._put(0, leaf, (at, at + 1))

    def _put(self, level: int, node: str, leaves: tuple[int, int]) -> None:
        self.open[level].append(node)
        self.under[level].append(leaves)
        if level < self.levels and len(self.open[level]) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The run of a level ends: every leaf below it gets the digests beside its own."""
        run, below = self.open[level], self.under[level]
        self.open[level], self.under[level] = [], []
        whole = "".join(run)
        for turn, (start, end) in enumerate(below):
            beside = whole[: turn * HEX] + whole[(turn + 1) * HEX :]
            for i in range(start, end):
                self.sides[i].append(beside)
                self.turns[i].append(turn)
        self._put(level + 1, digest(whole), (below[0][0], below[-1][1]))

    def close(self) -> str:
        """Ends the open runs from below; the digest of the block."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0]


def fold(leaf: str, sides: list[str], turns: list[int]) -> str:
    """The root that a leaf and its witness lead to."""
    for beside, turn in zip(sides, turns):
        leaf = digest(beside[: turn * HEX] + leaf + beside[turn * HEX :])
    return leaf


def placed(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, from 0 on by ``order`` in each ``group``, and ``n``, the size of the group.

    Rows are dealt by range over group and order, so that a large group lies in many
    partitions, and written with the number of their partition. One row per partition and
    group then tells what lies before. ``order`` must name rows uniquely enough that no
    value of it fills a partition; ``uid`` is its last column.
    """
    parts = max(1, -(-leaves.count() // PART_ROWS), leaves.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(leaves.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()))
    pieces = ranged.groupBy(group, "part").agg(F.count("*").alias("c"))
    mine = Window.partitionBy(group)
    before = mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col(group).alias("_g"), F.col("part").alias("_p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(mine).alias("n"))
    inner = Window.partitionBy(group, "part").orderBy(*order)
    rows = ranged.withColumn("inner", F.row_number().over(inner) - 1)
    met = rows.join(pieces, (F.col(group) == F.col("_g")) & (F.col("part") == F.col("_p")))
    return met.withColumn("pos", (F.col("before") + F.col("inner")).cast("bigint")).drop("_g", "_p", "before", "inner", "part")


def blocked(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """``nodes`` with the number of their aligned block."""
    return nodes.withColumn("block", F.floor(F.col("pos") / fanout**levels).cast("bigint"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (tree, block) of sorted batches, one block at a time."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


NODE = "tree string, pos bigint, n bigint, node string"
NODE_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
WITNESS = "tree string, pos bigint, sides array<string>, turns array<int>"
WITNESS_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("sides", pa.list_(pa.string())), ("turns", pa.list_(pa.int32()))])


def raised(nodes: DataFrame, levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(tree, pos, n, node) of the block roots of ``nodes``, which are (tree, pos, n, node)."""
    size = fanout**levels

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for rows in _runs(batches):
                n = rows[0]["n"]
                tree = Appender(min(levels, height(n, fanout)), fanout)
                for row in rows:
                    tree.append(row["node"])
                yield {"tree": rows[0]["tree"], "pos": rows[0]["block"], "n": -(-n // size), "node": tree.close()}

        return _batches(made(), NODE_ARROW)

    dealt = blocked(nodes.select("tree", "pos", "n", "node"), levels, fanout).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(climb, NODE)


def lowered(
    nodes: DataFrame, above: DataFrame, extra: dict[str, pa.DataType], finish: Callable[[dict, list[str], list[int]], dict], out: str, out_arrow: pa.Schema,
    levels: int = BLOCK_LEVELS, fanout: int = FANOUT,
) -> DataFrame:
    """``finish(row, sides, turns)`` for each node with its whole witness.

    ``above`` has the witness (tree, pos, sides, turns) of each block root. It travels as a row
    of the block that sorts before the nodes, so blocks of a large tree need no join on it.
    """
    names = list(extra)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for rows in _runs(batches):
                head = rows[0]
                tree = Appender(min(levels, height(rows[1]["n"], fanout)), fanout)
                for row in rows[1:]:
                    tree.append(row["node"])
                tree.close()
                for row, sides, turns in zip(rows[1:], tree.sides, tree.turns):
                    yield finish(row, sides + head["sides"], turns + head["turns"])

        return _batches(made(), out_arrow)

    empty = [F.lit(None).alias("sides"), F.lit(None).alias("turns")]
    low = blocked(nodes, levels, fanout).select("tree", "block", "pos", "n", "node", *names, *empty)
    kinds = dict(nodes.dtypes)
    high = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("node"), *[F.lit(None).cast(kinds[c]).alias(c) for c in names], "sides", "turns")
    dealt = low.unionByName(high).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(descend, out)


def _rise(nodes: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """The nodes and all their generations of block roots, up to one node for each tree; at least two."""
    table = [nodes]
    n = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        table.append(cut(raised(table[-1], levels, fanout)))
        n = -(-n // fanout**levels)
        if n <= 1:
            return table


def _witness(row: dict, sides: list[str], turns: list[int]) -> dict:
    return {"tree": row["tree"], "pos": row["pos"], "sides": sides, "turns": turns}


def _sink(table: list[DataFrame], top: DataFrame, levels: int, fanout: int) -> DataFrame:
    """Witnesses of the lowest but one generation of ``table``, from ``top``, those of the roots."""
    for nodes in reversed(table[1:-1]):
        top = cut(lowered(nodes, top, {}, _witness, WITNESS, WITNESS_ARROW, levels, fanout))
    return top


def manifest(docs: DataFrame, *, group: str = "lang", fields: tuple[str, ...] = FIELDS, changed: Column | None = None, levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    A leaf is the digest of ``fields``; leaves of a ``group`` ascend by doc_id (NULL first, ties
    by leaf: rows alike in all fields are interchangeable, each has its own place), groups
    ascend by name (NULL first, bytewise). ``changed`` is the text that is verified against the
    manifest (default: the text itself): its leaf is folded with the original witness, and
    ``verified`` says whether that gives the root. No rows give no rows; NULL and empty
    values differ in the leaf; columns beside ``fields`` are not looked at. Texts are hashed
    where they are read, only digests move.
    """
    named = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    values = [F.col(f) for f in fields]
    other = leaf_of([changed if f == "text" and changed is not None else F.col(f) for f in fields])
    leaf = leaf_of(values)
    tried = other if changed is None else F.when(F.col("text").eqNullSafe(changed), F.lit(None)).otherwise(other)
    # "n" sorts before "v", so the group of NULL comes first.
    leaves = cut(docs.select(named.alias("tree"), F.col("doc_id"), leaf.alias("node"), tried.alias("tried"), F.monotonically_increasing_id().alias("uid")))
    low = cut(placed(leaves, "tree", ["doc_id", "node", "uid"]))
    table = _rise(low, levels, fanout)
    tops = placed(table[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node", F.lit(0).alias("uid")), "tree", ["name", "uid"])
    upper = _rise(cut(tops), levels, fanout)
    # The root has no siblings; its witness comes down through the groups' roots to the groups.
    nothing = upper[-1].select("tree", "pos", F.array().cast("array<string>").alias("sides"), F.array().cast("array<int>").alias("turns"))
    start = _sink(upper, nothing, levels, fanout)

    def of_group(row: dict, sides: list[str], turns: list[int]) -> dict:
        # What the rows of a group need of it: its witness, and its subroot as the first text.
        return {"tree": row["name"], "pos": 0, "sides": [row["node"], *sides], "turns": [0, *turns]}

    def of_leaf(row: dict, sides: list[str], turns: list[int]) -> dict:
        # The subroot stands between the levels of the group and those above it.
        at = next(i for i, s in enumerate(sides) if s.startswith("="))
        subroot, sides, turns = sides[at][1:], sides[:at] + sides[at + 1 :], turns[:at] + turns[at + 1 :]
        root, folded = fold(subroot, sides[at:], turns[at:]), fold(row["tried"] or row["node"], sides, turns)
        return {
            "doc_id": row["doc_id"], "leaf": row["node"], "subroot": subroot, "root": root, "proof_sha256": digest("".join(sides)),
            "folded_root": folded, "verified": folded == root,
        }

    marked = lowered(upper[0], start, {"name": pa.string()}, of_group, WITNESS, WITNESS_ARROW, levels, fanout)
    marked = cut(marked.withColumn("sides", F.transform("sides", lambda s, i: F.when(i == 0, F.concat(F.lit("="), s)).otherwise(s))))
    above = _sink(table, marked, levels, fanout)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    arrow = pa.schema([("doc_id", id_type), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    return lowered(low, above, {"doc_id": id_type, "tried": pa.string()}, of_leaf, out, arrow, levels, fanout)
