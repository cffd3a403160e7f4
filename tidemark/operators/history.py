"""History: the commit graph, logs, change counts, replay, refs and annotations.

``commits`` has ``commit_id, seq, parents ARRAY<STRING>, author, message, commit_time``;
``seq`` is greater than that of every parent. ``changes`` has one row per commit and
changed key: ``seq, dataset, key, op`` (``put`` or ``del``) and the row's values.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import previous
from tidemark.session import cut


#: Commits (by seq) that one task walks, and how many tips it walks them for.
BLOCK, TIPS = 8192, 64


def linked(commits: DataFrame) -> DataFrame:
    """``commits`` with ``ups``: the seqs of their parents in order, NULL for one that is not in the table."""
    seqs = commits.select(F.col("commit_id").alias("_p"), F.col("seq").alias("_up"))
    edges = commits.select("seq", F.posexplode("parents").alias("_n", "_p")).join(seqs, "_p", "left")
    ups = edges.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_up"))), lambda x: x["_up"]).alias("ups"))
    return commits.join(ups, "seq", "left").withColumn("ups", F.coalesce("ups", F.array().cast("array<bigint>")))


def _in_block(first: int) -> Column:
    return F.col("seq").between(first, first + BLOCK - 1)


class CommitGraph:
    """Reachability over commits, block by block of their seqs, from the latest down.

    A commit comes after its parents, so what is reached inside a block is known once the
    block has been walked; parents in earlier blocks wait for theirs. A task holds one block
    of ``BLOCK`` commits, and there are as many rounds as blocks with something to walk,
    however merges are nested. ``commits`` that hold ``ups`` (see :func:`linked`), as those
    of a store do, are used as they are.
    """

    def __init__(self, commits: DataFrame):
        self.commits = commits if "ups" in commits.columns else cut(linked(cut(commits)))

    def first_parent_chain(self, tips: DataFrame) -> DataFrame:
        """``tip, commit_id`` for each tip (column ``tip``), its first parent, and so on down."""
        return self._walk(tips, True)

    def ancestors(self, tips: DataFrame) -> DataFrame:
        """``tip, commit_id`` for every commit reachable from each tip, itself included."""
        return self._walk(tips, False)

    def _walk(self, tips: DataFrame, first_only: bool) -> DataFrame:
        ids = self.commits.select("commit_id", "seq")
        frontier = cut(tips.select("tip").distinct().join(ids, F.col("tip") == F.col("commit_id")).select("tip", "seq"))
        found = frontier.limit(0)
        while True:
            top, n = frontier.agg(F.max("seq"), F.count_distinct("tip")).first()
            if top is None:
                return found.join(ids, "seq").select("tip", "commit_id")
            first = top // BLOCK * BLOCK
            chunks = ceil(n / TIPS)

            def walk(key: tuple, mine: pa.Table, block: pa.Table) -> pa.Table:
                names = sorted(set(mine.column("tip").to_pylist()))
                bit = {name: 1 << i for i, name in enumerate(names)}
                reached: dict[int, int] = {}
                for tip, seq in zip(mine.column("tip").to_pylist(), mine.column("seq").to_pylist()):
                    reached[seq] = reached.get(seq, 0) | bit[tip]
                ups = dict(zip(block.column("seq").to_pylist(), block.column("ups").to_pylist()))
                for seq in sorted(ups, reverse=True):
                    for up in (ups[seq][:1] if first_only else ups[seq]) if seq in reached else ():
                        if up is not None:
                            reached[up] = reached.get(up, 0) | reached[seq]
                out = [(name, seq) for seq, mask in reached.items() for name in names if mask & bit[name]]
                return pa.table({
                    "tip": pa.array([x[0] for x in out], pa.string()), "seq": pa.array([x[1] for x in out], pa.int64()),
                    "inside": pa.array([x[1] >= first for x in out], pa.bool_()),
                })

            here = frontier.filter(_in_block(first)).withColumn("chunk", F.pmod(F.xxhash64("tip"), F.lit(chunks)))
            block = self.commits.filter(_in_block(first)).select("seq", "ups", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk"))
            walked = here.groupBy("chunk").cogroup(block.groupBy("chunk")).applyInArrow(walk, "tip string, seq bigint, inside boolean")
            waiting = frontier.filter(F.col("seq") < first).withColumn("inside", F.lit(False))
            walked = cut(walked.unionByName(waiting).distinct())
            found = found.unionByName(walked.filter("inside").drop("inside"))
            frontier = walked.filter("NOT inside").drop("inside")

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """The latest common ancestor of each pair ``(a, b)``; NULL when unrelated.

        A common ancestor with the greatest ``seq`` cannot be reached from another one.
        """
        tips = pairs.select(F.explode(F.array("a", "b")).alias("tip")).distinct()
        up = cut(self.ancestors(tips))
        left = pairs.join(up.select(F.col("tip").alias("a"), "commit_id"), "a")
        common = left.join(up.select(F.col("tip").alias("b"), "commit_id"), ["b", "commit_id"])
        seqs = self.commits.select("commit_id", "seq")
        best = common.join(seqs, "commit_id").groupBy("a", "b").agg(
            F.max(F.struct("seq", "commit_id"))["commit_id"].alias("base")
        )
        return pairs.join(best, ["a", "b"], "left").select("a", "b", "base")

    def independent(self, tips: DataFrame) -> DataFrame:
        """Commits of a set that no other commit of the set reaches."""
        strict = tips.join(self.commits, tips["tip"] == self.commits["commit_id"]).select(F.explode("parents").alias("tip")).distinct()
        below = self.ancestors(strict).select(F.col("commit_id").alias("tip")).distinct()
        return tips.distinct().join(below, "tip", "left_anti")

    def ahead_behind(self, pairs: DataFrame) -> DataFrame:
        """For each ``(branch, upstream)``: commits only one of them has."""
        tips = pairs.select(F.explode(F.array("branch", "upstream")).alias("tip")).distinct()
        up = cut(self.ancestors(tips))
        mine = pairs.join(up.select(F.col("tip").alias("branch"), "commit_id"), "branch").withColumn("_m", F.lit(1))
        theirs = pairs.join(up.select(F.col("tip").alias("upstream"), "commit_id"), "upstream").withColumn("_t", F.lit(1))
        both = mine.join(theirs, ["branch", "upstream", "commit_id"], "full_outer")
        return both.groupBy("branch", "upstream").agg(
            F.sum(F.col("_t").isNull().cast("bigint")).alias("ahead"),
            F.sum(F.col("_m").isNull().cast("bigint")).alias("behind"),
        )


def log(graph: CommitGraph, tips: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Commits reachable from the tips, each once, with the names of the refs that point at it."""
    reach = graph.ancestors(tips).select("commit_id").distinct()
    out = graph.commits.join(reach, "commit_id", "left_semi")
    if refs is not None:
        names = refs.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("refs"))
        out = out.join(names, "commit_id", "left")
    return out


def commits_touching(commits: DataFrame, changes: DataFrame, item: Column) -> DataFrame:
    """Commits that changed an item."""
    return commits.join(changes.filter(item).select("seq").distinct(), "seq", "left_semi")


def tree_changes(commits: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets whose tree differs from the first parent's: ``commit_id, path, old_tree, new_tree``.

    A root commit changes every dataset it has. ``versions`` has ``commit_id, path, tree``.
    """
    parent = commits.select("commit_id", F.get("parents", F.lit(0)).alias("parent"))
    new = versions.select("commit_id", "path", F.col("tree").alias("new_tree"))
    old = parent.join(versions.select(F.col("commit_id").alias("parent"), "path", F.col("tree").alias("old_tree")), "parent")
    both = new.join(old.select("commit_id", "path", "old_tree"), ["commit_id", "path"], "full_outer")
    return both.filter(~F.col("old_tree").eqNullSafe(F.col("new_tree")))


def first_parent_lanes(commits: DataFrame) -> DataFrame:
    """Commits dealt into lanes: ``seq, lane, up_lane, fork_seq``.

    A lane goes on from a commit to that commit on top of it (by first parents) on which most
    commits stand, the earlier one of two that are alike; the others open lanes of their own,
    which hang on the commit with seq ``fork_seq`` of lane ``up_lane``. A lane is named by the
    seq it starts at. Going over to the lane above at least doubles what stands on a commit,
    so lanes nest no deeper than the logarithm of the number of commits.

    Blocks of ``BLOCK`` commits are weighed from the latest down, each in one task; what stands
    on a commit in later blocks is summed up before it gets there. ``commits`` that hold
    lanes, as those of a store do, are used as they are.
    """
    if "lane" in commits.columns:
        return commits.select("seq", "lane", "up_lane", "fork_seq")
    own = commits if "ups" in commits.columns else cut(linked(cut(commits)))
    own = own.select("seq", F.get("ups", F.lit(0)).alias("up"))
    top, low = own.agg(F.max("seq"), F.min("seq")).first()
    schema = "seq bigint, up bigint, weight bigint, heir bigint, head bigint"
    done = own.sparkSession.createDataFrame([], schema)
    firsts = [] if top is None else range(top // BLOCK * BLOCK, low // BLOCK * BLOCK - 1, -BLOCK)
    for first in firsts:

        def weigh(key: tuple, mine: pa.Table, above: pa.Table) -> pa.Table:
            up = dict(zip(mine.column("seq").to_pylist(), mine.column("up").to_pylist()))
            weight, best = dict.fromkeys(up, 1), {}
            for row in above.to_pylist():
                weight[row["up"]] += row["weight"]
                best[row["up"]] = (row["most"], -row["child"])
            for seq in sorted(up, reverse=True):
                if up[seq] in up:
                    weight[up[seq]] += weight[seq]
                    best[up[seq]] = max(best.get(up[seq], (0, 0)), (weight[seq], -seq))
            head: dict[int, int] = {}
            for seq in sorted(up):
                goes_on = up[seq] in up and best[up[seq]][1] == -seq
                head[seq] = head[up[seq]] if goes_on else seq
            seqs = list(up)
            columns = [seqs, [up[s] for s in seqs], [weight[s] for s in seqs], [-best[s][1] if s in best else None for s in seqs], [head[s] for s in seqs]]
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["seq", "up", "weight", "heir", "head"])

        into = done.filter(F.col("up").between(first, first + BLOCK - 1)).groupBy("up").agg(
            F.sum("weight").alias("weight"), F.max("weight").alias("most"), (-F.max(F.struct("weight", -F.col("seq")))["col2"]).alias("child")
        )
        block = own.filter(_in_block(first)).groupBy(F.lit(first).alias("first"))
        done = done.unionByName(cut(block.cogroup(into.groupBy(F.lit(first).alias("first"))).applyInArrow(weigh, schema)))
    # Heads whose lane goes on in an earlier block: steps from block to block, doubled from round to round.
    heads = done.select(F.col("seq").alias("up"), F.col("heir").alias("_heir"), F.col("head").alias("_next"))
    steps = done.filter("seq = head").join(heads, "up", "left").select(
        "head", "up", F.when(F.col("_heir") == F.col("head"), F.col("_next")).otherwise(F.col("head")).alias("lane")
    )
    for _ in range(max(len(firsts) - 1, 0).bit_length()):
        on = steps.select(F.col("head").alias("lane"), F.col("lane").alias("_next"))
        steps = cut(steps.join(on, "lane").select("head", "up", F.col("_next").alias("lane")))
    lanes = cut(done.select("seq", "head").join(steps.select("head", "lane"), "head").select("seq", "lane"))
    forks = steps.filter("head = lane AND up IS NOT NULL").select("lane", F.col("up").alias("fork_seq"))
    above = lanes.select(F.col("seq").alias("fork_seq"), F.col("lane").alias("up_lane"))
    return cut(lanes.join(forks.join(above, "fork_seq", "left"), "lane", "left").select("seq", "lane", "up_lane", "fork_seq"))


def previous_on_first_parents(changes: DataFrame, commits: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``changes`` with ``prev_<value>`` of the last change of the same key before it, along first parents.

    The changes of a commit are those against its first parent. Inside a lane the change
    before is the one with the next smaller seq. The first change of a key in a lane looks at
    the lane it hangs on, up to the fork, then at the one above that: a round per nesting
    of lanes, over the keys that have not been found yet.
    """
    key, values = list(key), list(values)
    lanes = first_parent_lanes(commits)
    rows = changes.join(lanes.select("seq", "lane"), "seq")
    seen = cut(previous(rows.withColumn("own", F.col("seq")), [*key, "lane"], "seq", ["own", *values]).withColumnRenamed("prev_own", "prev_seq"))
    table = seen.select(*key, F.col("lane").alias("up_lane"), F.col("seq").alias("_s"), *[F.col(v).alias(f"_v_{v}") for v in values])
    above = lanes.select("lane", "up_lane", "fork_seq").distinct()
    todo = cut(seen.filter(F.col("prev_seq").isNull()).select(*key, F.col("seq").alias("_of"), "lane").join(above, "lane").filter(F.col("up_lane").isNotNull()).drop("lane"))
    found = None
    while not todo.isEmpty():
        below = todo.join(table, [*key, "up_lane"]).filter(F.col("_s") <= F.col("fork_seq"))
        hit = cut(below.groupBy(*key, "_of").agg(F.max_by(F.struct(*[f"_v_{v}" for v in values]), "_s").alias("_hit")))
        found = hit if found is None else found.unionByName(hit)
        rest = todo.join(hit.select(*key, "_of"), [*key, "_of"], "left_anti").select(*key, "_of", F.col("up_lane").alias("lane"))
        todo = cut(rest.join(above, "lane").filter(F.col("up_lane").isNotNull()).drop("lane"))
    out = seen
    if found is not None:
        out = out.join(found.withColumnRenamed("_of", "seq"), [*key, "seq"], "left")
        out = out.withColumns({f"prev_{v}": F.when(F.col("prev_seq").isNull(), F.col(f"_hit._v_{v}")).otherwise(F.col(f"prev_{v}")) for v in values}).drop("_hit")
    return out.select(*changes.columns, *[f"prev_{v}" for v in values])


def on_chain(changes: DataFrame, graph: CommitGraph, tips: DataFrame) -> DataFrame:
    """Changes of the commits on the first-parent chains of ``tips`` (column ``tip``)."""
    chain = graph.commits.join(graph.first_parent_chain(tips).select("commit_id").distinct(), "commit_id", "left_semi")
    return changes.join(chain.select("seq"), "seq", "left_semi")


def typed_changes(changes: DataFrame, commits: DataFrame, key: Sequence[str] = ("dataset", "key"), values: Sequence[str] = ()) -> DataFrame:
    """Adds ``change_type`` from the operation before it on first parents; a delete of nothing is dropped.

    ``values`` come along as they were before, as ``prev_<value>``; NULL where there was no row.
    """
    seen = previous_on_first_parents(changes, commits, key, ["op", *values])
    for v in values:
        seen = seen.withColumn(f"prev_{v}", F.when(F.col("prev_op") == "put", F.col(f"prev_{v}")))
    was = F.coalesce(F.col("prev_op") == "put", F.lit(False))
    kind = (
        F.when((F.col("op") == "put") & was, "update").when(F.col("op") == "put", "insert").when(was, "delete")
    )
    return seen.withColumn("change_type", kind).filter(F.col("change_type").isNotNull()).drop("prev_op")


def counts_per_commit(typed: DataFrame) -> DataFrame:
    """Inserts, updates and deletes of every commit and dataset, in one pass over the changes."""
    from tidemark.operators.aggregates import type_count_columns

    return type_count_columns(typed, ["seq", "dataset"])


def snapshot(changes: DataFrame, seq, key: Sequence[str] = ("dataset", "key"), values: Sequence[str] = ("value",)) -> DataFrame:
    """Rows at a version: the latest change of each key up to ``seq``, deletes dropped.

    The latest change is an aggregate, not a ranking: each task keeps one row per key,
    so a key that holds most of the changes costs one row per task in the shuffle.
    """
    upto = changes.filter(F.col("seq") <= seq)
    latest = upto.groupBy(*key).agg(F.max_by(F.struct("op", *values), F.col("seq")).alias("_last"))
    return latest.filter(F.col("_last.op") == "put").select(*key, *[F.col(f"_last.{v}").alias(v) for v in values])


def row_history(changes: DataFrame, item: Column, key: Sequence[str] = ("dataset", "key"), values: Sequence[str] = ("value",)) -> DataFrame:
    """Every version of an item with the version before it, in the changes of one chain (see :func:`on_chain`)."""
    return previous(changes.filter(item), list(key), "seq", list(values))


def objects_between(changes: DataFrame, seqs: DataFrame, oid: str = "oid") -> DataFrame:
    """Rows introduced by the given commits, each distinct object once, at its first commit."""
    new = changes.join(seqs.select("seq").distinct(), "seq", "left_semi")
    first = new.groupBy(oid).agg(F.min(F.struct("seq", "dataset")).alias("_f"))
    return first.select(oid, F.col("_f.seq").alias("seq"), F.col("_f.dataset").alias("dataset"))


def annotate(cache: DataFrame, wanted: DataFrame, symmetric: bool) -> DataFrame:
    """Cached results for ``(kind, base, target)`` requests.

    A symmetric result is stored once for both directions. An ordered one can be read
    backwards: inserts and deletes trade places (``reversed``).
    """
    if symmetric:
        def pair(df: DataFrame) -> DataFrame:
            return df.withColumn("_p", F.sort_array(F.array("base", "target")))

        hits = pair(cache).select("kind", "_p", "data").dropDuplicates(["kind", "_p"])
        return pair(wanted).join(hits, ["kind", "_p"], "left").drop("_p").withColumn("reversed", F.lit(False))
    straight = cache.select("kind", "base", "target", F.col("data").alias("_d1"))
    back = cache.select("kind", F.col("target").alias("base"), F.col("base").alias("target"), F.col("data").alias("_d2"))
    both = wanted.join(straight, ["kind", "base", "target"], "left").join(back, ["kind", "base", "target"], "left")
    return both.select(
        *wanted.columns,
        F.coalesce("_d1", "_d2").alias("data"),
        (F.col("_d1").isNull() & F.col("_d2").isNotNull()).alias("reversed"),
    )


def missing_annotations(commits: DataFrame, cache: DataFrame) -> DataFrame:
    return commits.join(cache.select("commit_id").distinct(), "commit_id", "left_anti")


def crs_applicable(rows: DataFrame, crs_history: DataFrame, salts: int = 64) -> DataFrame:
    """Every reference system a dataset had at a row's commit or later.

    ``crs_history`` has ``dataset, seq, crs``; it becomes one row per dataset, with the last commit of
    each system it ever had. That table is written, so Spark knows its size and broadcasts a
    small one. Where it is too large for that, the join is on (dataset, salt), so that a dataset
    with most of the rows is ``salts`` groups.
    """
    last = crs_history.groupBy("dataset", "crs").agg(F.max("seq").alias("last_seq"))
    systems = cut(last.groupBy("dataset").agg(F.collect_list(F.struct("crs", "last_seq")).alias("_systems")))
    salted = systems.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Any even spread will do; nested values such as geometries would be dear to hash.
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("struct", "array", "map"))]
    met = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")).join(salted, ["dataset", "_salt"])
    fitting = F.filter("_systems", lambda s: s["last_seq"] >= F.col("seq"))
    return met.withColumn("_system", F.explode(fitting)).select(*rows.columns, F.col("_system.crs").alias("crs"))


def previous_import(items: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The last commit that changed a meta item, per item, in the items of one chain (see :func:`on_chain`)."""
    seen = previous(items, list(key), "seq", [value])
    changed = seen.filter(~F.col(value).eqNullSafe(F.col(f"prev_{value}")))
    return changed.groupBy(*key).agg(F.max("seq").alias("last_changed_seq"))
