import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, merging


def table(spark, rows):
    return spark.createDataFrame(rows, "fid long, name string")


def test_renumber_moves_one_side_above_all_keys(spark):
    base = table(spark, [(1, "a")])
    ours = table(spark, [(1, "a"), (98001, "ours"), (98000, "mine")])
    theirs = table(spark, [(1, "a"), (98001, "theirs")])
    merged = merging.merge(base, ours, theirs, ["fid"])
    resolves = merging.renumber(merging.conflicts(merged), ours, theirs, "fid", "theirs")
    assert sorted((r["from"], r.row.fid, r.row.name) for r in resolves.collect()) == [("ours", 98001, "ours"), ("theirs", 98002, "theirs")]
    done = merging.finish(merged, resolves)
    assert sorted(tuple(r) for r in done.collect()) == [(1, "a"), (98000, "mine"), (98001, "ours"), (98002, "theirs")]


def test_finish_needs_every_conflict_resolved(spark):
    base, ours, theirs = (table(spark, [(1, v)]) for v in "abc")
    merged = merging.merge(base, ours, theirs, ["fid"])
    with pytest.raises(Exception, match="unresolved conflicts: 1"):
        merging.finish(merged, merging.resolve_with(merging.conflicts(merged).limit(0), "ours")).collect()
    assert [r.name for r in merging.merged_snapshot(merged).collect()] == ["b"]
    assert merging.merged_snapshot(merged, None, None).collect() == []


def test_merge_kinds():
    assert merging.merge_kind("b", "o", "b") == "no_op"
    assert merging.merge_kind("o", "o", "t") == "fast_forward"
    assert merging.merge_kind("o", "o", "t", "never") == "merge"
    assert merging.merge_kind(None, "o", "t") == "unrelated"
    with pytest.raises(ValueError):
        merging.merge_kind("b", "o", "t", "only")


def test_patterns():
    assert filters.parse_pattern("a/b") == ("a/b", None, None)
    assert filters.parse_pattern("a*:meta") == ("a*", "meta", None) and filters.parse_pattern("a:metadata") == ("a", "feature", "metadata")
    assert filters.parse_pattern("a:tile:x:y") == ("a", "tile", "x:y") and filters.parse_pattern("a:") == ("a", None, None)
    assert filters.parse_pattern("ds:123") == ("ds", "feature", "123")
    assert filters.parse_pattern("ds:meta:title") == ("ds", "meta", "title")
    assert filters.parse_pattern("ds:feature") == ("ds", "feature", None)
    for bad in ("/a", "a/", ".a", "a/./b", "<a"):
        with pytest.raises(ValueError):
            filters.parse_pattern(bad)


def test_pattern_matching(spark):
    rows = [("a", "feature", "1"), ("a", "meta", "title"), ("ab", "feature", "1"), ("x.b", "feature", "2")]
    df = spark.createDataFrame(rows, "d string, p string, k string")

    def match(*patterns):
        return [tuple(r) for r in df.filter(filters.matches_patterns(patterns, F.col("d"), F.col("p"), F.col("k"))).collect()]

    assert match() == rows
    assert match("a") == rows[:2]
    assert match("a*:1") == [rows[0], rows[2]]
    assert match("*.b") == [rows[3]]
    assert match("a:meta", "ab:feature:1") == [rows[1], rows[2]]
    assert match("a:feature", "a:9") == [rows[0]]


def test_lookup_of_missing_key(spark):
    df = table(spark, [(1, "a"), (2, "b")])
    keys = spark.createDataFrame([(2,), (7,)], "fid long")
    assert [r.name for r in filters.lookup(df, keys, "fid").collect()] == ["b"]
    with pytest.raises(Exception, match="no row with key 7"):
        filters.lookup(df, keys, "fid", ignore_missing=False).collect()


def test_a_file_resolves_only_what_it_answers(spark):
    from tidemark.operators import merging

    ancestor = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    ours = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k long, v string")
    theirs = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y")], "k long, v string")
    found = merging.conflicts(merging.merge(ancestor, ours, theirs, ["k"]))
    edited = spark.createDataFrame([(1, "z")], "k long, v string")
    assert [(r.key, r.row.v) for r in merging.resolve_from(found, edited, ["k"]).collect()] == [(1, "z")]
    keys = spark.createDataFrame([(1,), (2,)], "key long")
    answered = {r.key: r.row for r in merging.resolve_from(found, edited, ["k"], keys=keys).collect()}
    assert set(answered) == {1, 2} and answered[2] is None and answered[1].v == "z"
