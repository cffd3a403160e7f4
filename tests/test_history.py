import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.operators.history import CommitGraph, first_parent_lanes


def random_dag(n, seed):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        parents = []
        if i:
            parents = [f"c{p}" for p in rnd.sample(range(max(0, i - 4), i), k=min(i, rnd.choice([1, 1, 1, 2, 2, 3])))]
        out[f"c{i}"] = parents
    return out


def reach(dag, tip):
    seen, todo = set(), [tip]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += dag[c]
    return seen


def commit_table(spark, dag):
    return spark.createDataFrame([(c, int(c[1:]), p) for c, p in dag.items()], "commit_id string, seq long, parents array<string>")


@pytest.mark.parametrize("n,seed,block,tips_in_task", [(1, 0, 8192, 64), (40, 1, 8192, 64), (40, 2, 11, 1)])
def test_ancestors_of_random_graphs(spark, monkeypatch, n, seed, block, tips_in_task):
    monkeypatch.setattr(history, "BLOCK", block)
    monkeypatch.setattr(history, "TIPS", tips_in_task)
    dag = random_dag(n, seed)
    commits = spark.createDataFrame([(c, int(c[1:]), p) for c, p in dag.items()], "commit_id string, seq long, parents array<string>")
    graph = CommitGraph(commits)
    tips = sorted({f"c{n - 1}", f"c{n // 2}"})
    got = graph.ancestors(spark.createDataFrame([(t,) for t in tips], "tip string")).collect()
    assert {t: {r.commit_id for r in got if r.tip == t} for t in tips} == {t: reach(dag, t) for t in tips}
    if n > 1:
        a, b = f"c{n - 1}", f"c{n - 2}"
        pairs = spark.createDataFrame([(a, b)], "a string, b string")
        common = reach(dag, a) & reach(dag, b)
        assert graph.merge_bases(pairs).first().base == max(common, key=lambda c: int(c[1:]))
        renamed = pairs.select(F.col("a").alias("branch"), F.col("b").alias("upstream"))
        r = graph.ahead_behind(renamed).first()
        assert (r.ahead, r.behind) == (len(reach(dag, a) - reach(dag, b)), len(reach(dag, b) - reach(dag, a)))


def test_unrelated_histories(spark):
    commits = spark.createDataFrame([("a", 0, []), ("b", 1, [])], "commit_id string, seq long, parents array<string>")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert CommitGraph(commits).merge_bases(pairs).first().base is None


def line_below(dag, tip):
    out = [tip]
    while dag[out[-1]]:
        out.append(dag[out[-1]][0])
    return out


@pytest.mark.parametrize("n,seed,block", [(1, 0, 8192), (60, 3, 8192), (60, 4, 13)])
def test_lanes_make_up_every_first_parent_chain(spark, monkeypatch, n, seed, block):
    monkeypatch.setattr(history, "BLOCK", block)
    dag = random_dag(n, seed)
    rows = {r.seq: r for r in first_parent_lanes(commit_table(spark, dag)).collect()}
    members = {}
    for r in rows.values():
        members.setdefault(r.lane, []).append(r.seq)
    assert sorted(rows) == list(range(n))
    for seq in range(0, n, 7):
        seen, at, hops = [], seq, 0
        while at is not None:
            r = rows[at]
            seen += [s for s in members[r.lane] if s <= at]
            assert (r.up_lane is None) == (r.fork_seq is None) and (r.fork_seq is None or rows[r.fork_seq].lane == r.up_lane)
            at, hops = r.fork_seq, hops + 1
        assert sorted(seen) == sorted(int(c[1:]) for c in line_below(dag, f"c{seq}"))
        assert hops <= n.bit_length()


def test_lanes_of_no_commits_and_of_a_cut_off_history(spark):
    none = spark.createDataFrame([], "commit_id string, seq long, parents array<string>")
    assert first_parent_lanes(none).count() == 0
    cut_off = spark.createDataFrame([("c5", 5, ["c1"]), ("c6", 6, ["c5", "gone"])], none.schema)
    assert {tuple(r) for r in first_parent_lanes(cut_off).collect()} == {(5, 5, None, None), (6, 5, None, None)}
    assert CommitGraph(cut_off).ancestors(spark.createDataFrame([("c6",), ("gone",)], "tip string")).count() == 2
