import pytest
from pyspark.sql import functions as F

from tidemark.operators import algebra, diffing, patches

SCHEMA = "old_key int, new_key int, change_type string, old struct<k:int,v:string>, new struct<k:int,v:string>, flags int"


def delta(spark, kind, old, new, flags=0):
    o = None if kind == "insert" else (1, old)
    n = None if kind == "delete" else (1, new)
    return spark.createDataFrame([(1 if o else None, 1 if n else None, kind, o, n, flags)], SCHEMA)


CASES = [
    ("insert", (None, "a"), "insert", (None, "b"), "conflict"),
    ("insert", (None, "a"), "update", ("a", "b"), ("insert", None, "b")),
    ("insert", (None, "a"), "delete", ("a", None), None),
    ("update", ("a", "b"), "insert", (None, "c"), "conflict"),
    ("update", ("a", "b"), "update", ("b", "c"), ("update", "a", "c")),
    ("update", ("a", "b"), "update", ("b", "a"), None),
    ("update", ("a", "b"), "delete", ("b", None), ("delete", "a", None)),
    ("delete", ("a", None), "insert", (None, "b"), ("update", "a", "b")),
    ("delete", ("a", None), "insert", (None, "a"), None),
    ("delete", ("a", None), "update", ("a", "b"), "conflict"),
    ("delete", ("a", None), "delete", ("a", None), "conflict"),
]


@pytest.mark.parametrize("first,a,second,b,expected", CASES)
def test_composition_table(spark, first, a, second, b, expected):
    both = algebra.compose(delta(spark, first, *a, flags=1), delta(spark, second, *b, flags=2)).collect()
    if expected is None:
        assert both == []
        return
    row = both[0]
    assert row.flags == 3
    if expected == "conflict":
        assert row.conflict
        with pytest.raises(Exception, match="cannot concatenate"):
            algebra.concatenate(delta(spark, first, *a), delta(spark, second, *b)).collect()
        return
    kind, old, new = expected
    assert (row.change_type, row.old and row.old.v, row.new and row.new.v) == (kind, old, new)


def test_nulls_and_zero_are_told_apart(spark):
    old = spark.createDataFrame([(1, None, "a", 0.0), (2, "", None, float("nan"))], "k int, a string, b string, d double")
    new = spark.createDataFrame([(1, "a", None, -0.0), (2, None, None, float("nan"))], "k int, a string, b string, d double")
    for strategy in ("wide", "hash_first"):
        found = diffing.diff(old, new, ["k"], strategy=strategy)
        assert sorted(r.old_key for r in found.collect()) == [1, 2]
    fields = {(r.old_key, r.field) for r in diffing.field_changes(diffing.diff(old, new, ["k"])).collect()}
    assert fields == {(1, "a"), (1, "b"), (2, "a")}


def test_compound_keys(spark):
    old = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "a int, b string, v int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (2, "x", 4)], "a int, b string, v int")
    found = {(r.key, r.change_type) for r in diffing.diff(old, new, ["a", "b"]).select(
        F.concat_ws(",", F.coalesce("old_key", "new_key")["a"].cast("string"), F.coalesce("old_key", "new_key")["b"]).alias("key"), "change_type").collect()}
    assert found == {("1,y", "update"), ("2,x", "insert")}


def test_rename_takes_highest_key_of_equal_content(spark):
    old = spark.createDataFrame([(1, "same"), (2, "same"), (3, "kept")], "k int, v string")
    new = spark.createDataFrame([(3, "kept"), (8, "same"), (9, "same"), (7, "same")], "k int, v string")
    found = algebra.find_renames(diffing.diff(old, new, ["k"]), ["v"]).collect()
    assert [(r.old_key, r.new_key) for r in found if r.change_type == "update"] == [(2, 9)]
    assert sorted(r.change_type for r in found) == ["delete", "insert", "insert", "update"]


def test_patch_conflict_stops_everything(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    good = delta(spark, "update", "a", "z")
    good = good.withColumn("old", F.col("old").cast("struct<k:int,v:string>"))
    assert sorted(tuple(r) for r in patches.apply_checked(good, current, "k").collect()) == [(1, "z"), (2, "b")]
    stale = delta(spark, "update", "not a", "z")
    with pytest.raises(Exception, match="patch does not apply"):
        patches.apply_checked(stale, current, "k").collect()
    # A delete does not compare old values.
    gone = delta(spark, "delete", "not a", None)
    assert [tuple(r) for r in patches.apply_checked(gone, current, "k").collect()] == [(2, "b")]
