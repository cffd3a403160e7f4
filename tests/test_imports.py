import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, imports
from tidemark.schema import ColumnSpec, VersionedSchema
from tidemark.store import InvalidRows, NoChanges, VersionStore


@pytest.fixture()
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "repo"))


def rows(spark, *values, schema="k long, v string"):
    return spark.createDataFrame(list(values), schema)


SHORT = VersionedSchema((ColumnSpec("i1", "k", "integer", 0, {"size": 16}), ColumnSpec("i2", "v", "text", None, {"length": 2})))


def test_refusals_of_a_new_dataset(spark, store):
    with pytest.raises(InvalidRows, match="v: 'long'"):
        imports.import_new(store, "t", rows(spark, (1, "a"), (2, "long")), ["k"], "one", schema=SHORT)
    with pytest.raises(InvalidRows, match="k: '70000'"):
        imports.import_new(store, "t", rows(spark, (70000, "a")), ["k"], "one", schema=SHORT)
    with pytest.raises(InvalidRows, match="unique"):
        imports.import_new(store, "t", rows(spark, (1, "a"), (1, "b")), ["k"], "one", schema=SHORT)
    with pytest.raises(ValueError, match="columns or keys"):
        imports.import_new(store, "t", rows(spark, (1,), schema="k long"), ["k"], "one", schema=SHORT)
    imports.import_new(store, "t", rows(spark, (1, "a"), (2, None)), ["k"], "one", schema=SHORT)
    assert dict(store.read("t", "main").dtypes) == {"k": "smallint", "v": "string"}
    for taken in ("t", "T"):
        with pytest.raises(ValueError, match="there is a dataset"):
            imports.import_new(store, taken, rows(spark, (1, "a")), ["k"], "again")
    with pytest.raises(KeyError, match="no dataset"):
        imports.import_over(store, "u", rows(spark, (1, "a")), "none")


def test_empty_table_and_no_changes(spark, store):
    imports.import_new(store, "t", rows(spark), ["k"], "empty", meta={"title": "T"})
    assert store.read("t", "main").count() == 0
    with pytest.raises(NoChanges):
        imports.import_over(store, "t", rows(spark), "same")
    imports.import_over(store, "t", rows(spark, (1, "a")), "rows", meta={"description": "d"})
    assert store.version("t", "main").meta == {"title": "T", "description": "d"}
    with pytest.raises(NoChanges):
        imports.import_over(store, "t", rows(spark, (1, "a")).select("k", "v"), "same")


def test_walk_over_schema_changes_and_a_new_key(spark, store):
    def schema():
        return store.version("t", "main").schema

    wide = "k long, v string, n int"
    imports.import_new(store, "t", rows(spark, (1, "a"), (2, "b"), (3, "c")), ["k"], "one")
    assert imports.last_schema_change(store, "t", schema()) is None
    first = store.resolve("main")
    imports.import_over(store, "t", rows(spark, (1, "a", None), (2, "b", 5), (3, "c", None), schema=wide), "n added")
    second = store.resolve("main")
    imports.import_over(store, "t", rows(spark, (1, "a", None), (2, "b", 6), (4, "d", None), schema=wide), "rows")
    # The schema of the import is that of two versions; the one below them lacks a column.
    assert imports.last_schema_change(store, "t", schema()) == imports.SchemaChange(first, 1, 0, False)
    assert sorted((r.k, r.seq) for r in imports.written(store, "t").collect()) == [(1, 0), (2, 2), (4, 2)]
    assert sorted((r.k, r.seq) for r in imports.written(store, "t", second).collect()) == [(1, 0), (2, 1), (3, 0)]
    renamed = rows(spark, (1, "a", None), (2, "b", 6), (4, "d", None), schema="k long, w string, n int")
    imports.import_over(store, "t", renamed, "v is w")
    assert imports.last_schema_change(store, "t", schema()).commit_id == first  # a renamed column is passed over
    imports.import_over(store, "t", renamed, "keyed anew", pk=["w"])
    found = imports.last_schema_change(store, "t", schema())
    assert found.key_changed and not found.comparable
    assert {r.seq for r in imports.written(store, "t").collect()} == {4}
    store.commit({"t": None}, "dropped")
    imports.import_new(store, "t", rows(spark, (1, "a")), ["k"], "back")
    assert imports.last_schema_change(store, "t", schema()) is None  # what was dropped is another dataset


def test_systems_of_a_dataset_with_most_rows(spark):
    data = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.lit("b")).when(F.col("id") == 7, None).otherwise("a").alias("dataset"), (F.col("id") % 6).alias("seq"), "id"
    )
    systems = spark.createDataFrame([("a", 0, "x"), ("a", 2, "x"), ("a", 4, "y"), ("b", 5, "z"), ("b", 5, "z")], "dataset string, seq long, crs string")
    got = sorted(tuple(r) for r in history.crs_applicable(data, systems).select("id", "crs").collect())
    last = {"a": {"x": 2, "y": 4}, "b": {"z": 5}}
    want = sorted((r.id, crs) for r in data.collect() for crs, seq in last.get(r.dataset, {}).items() if seq >= r.seq)
    assert got == want
