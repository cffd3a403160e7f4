import pytest
from pyspark.sql import functions as F

from tidemark.operators import merging
from tidemark.operators.schemas import violation_examples
from tidemark.schema import ColumnSpec, VersionedSchema
from tidemark.store import DoesNotFit, InvalidRows, NoChanges, VersionStore


@pytest.fixture()
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "repo"))


def rows(spark, *values, schema="k long, v string"):
    return spark.createDataFrame(list(values), schema)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_commit_read_diff_and_branches(spark, store):
    first = store.commit({"t": rows(spark, (1, "a"), (2, "b"), (3, "c"))}, "one", pks={"t": ["k"]})
    second = store.commit({"t": rows(spark, (1, "a"), (2, "B"), (4, "d"))}, "two")
    assert content(store.read("t", "main")) == [(1, "a"), (2, "B"), (4, "d")]
    assert content(store.read("t", "main^")) == [(1, "a"), (2, "b"), (3, "c")]
    kinds = {(r.old_key, r.new_key): r.change_type for r in store.diff("t", first, second).collect()}
    assert kinds == {(2, 2): "update", (3, None): "delete", (None, 4): "insert"}
    store.move_ref("side", first)
    side = store.commit({"t": rows(spark, (1, "A"), (2, "b"), (3, "c"))}, "side", ref="side")
    assert content(store.read("t", "main")) == [(1, "a"), (2, "B"), (4, "d")]
    assert content(store.read("t", "side")) == [(1, "A"), (2, "b"), (3, "c")]
    assert store.range_ends("main..side") == (first, side)
    merged = merging.merge(store.read("t", first), store.read("t", "main"), store.read("t", "side"), ["k"])
    result = merging.finish(merged, merging.resolve_with(merging.conflicts(merged), "ours"))
    store.commit({"t": result}, "merge", parents=[second, side])
    assert content(store.read("t", "main")) == [(1, "A"), (2, "B"), (4, "d")]
    assert store.commits().count() == 4


def test_no_changes(spark, store):
    store.commit({"t": rows(spark, (1, "a"))}, "one", pks={"t": ["k"]})
    with pytest.raises(NoChanges):
        store.commit({"t": rows(spark, (1, "a"))}, "again")
    store.commit({"t": rows(spark, (1, "a"))}, "empty", allow_empty=True)
    with pytest.raises(KeyError):
        store.read("missing", "main")


def test_schema_evolution_keeps_ids(spark, store):
    store.commit({"t": rows(spark, (1, "a", 5), (2, "b", 6), schema="k long, v string, n int")}, "one", pks={"t": ["k"]})
    renamed = rows(spark, (1, "a", 5), (2, "b", 7), schema="k long, title string, n int")
    store.commit({"t": renamed}, "rename")
    assert store.read("t", "main").columns == ["k", "title", "n"]
    assert content(store.read("t", "main")) == [(1, "a", 5), (2, "b", 7)]
    assert content(store.read("t", "main^")) == [(1, "a", 5), (2, "b", 6)]
    stored = spark.read.parquet(f"{store.root}/data/{store.version('t', 'main').slot}/changes")
    assert stored.filter("seq = 1").count() == 1
    kinds = [(r.old_key, r.change_type) for r in store.diff("t", "main^", "main").collect()]
    assert kinds == [(2, "update")]


def test_drop_amend_and_dataset_list(spark, store):
    store.commit({"t": rows(spark, (1, "a")), "u": rows(spark, (9, "z"))}, "one", pks={"t": ["k"], "u": ["k"]})
    store.commit({"u": None}, "drop u")
    assert [r.path for r in store.datasets("main").collect()] == ["t"]
    assert sorted(r.path for r in store.datasets("main~1").collect()) == ["t", "u"]
    before = store.resolve("main^")
    store.commit({"t": rows(spark, (1, "amended"))}, "amended", amend=True)
    assert store.resolve("main^") == before
    assert content(store.read("t", "main")) == [(1, "amended")]


def test_replay_through_snapshots(spark, store, monkeypatch):
    monkeypatch.setattr("tidemark.store.SNAPSHOT_EVERY", 2)
    current = {i: "v0" for i in range(6)}
    store.commit({"t": rows(spark, *current.items())}, "0", pks={"t": ["k"]})
    for i in range(1, 4):
        current.pop(i)
        current[i + 100] = f"new{i}"
        current[0] = f"v{i}"
        store.commit({"t": rows(spark, *current.items())}, str(i))
    assert content(store.read("t", "main")) == sorted(current.items())


def test_rows_that_break_their_schema(spark):
    schema = VersionedSchema((ColumnSpec("1", "k", "integer", 0, {"size": 64}), ColumnSpec("2", "v", "date")))
    assert [r.rule for r in violation_examples(rows(spark, (1, "a")), schema).collect()] == ["pattern"]


def test_repeated_and_absent_keys_are_refused(spark, store):
    with pytest.raises(InvalidRows, match="unique"):
        store.commit({"t": rows(spark, (1, "a"), (1, "b"))}, "twice", pks={"t": ["k"]})
    with pytest.raises(InvalidRows):
        store.commit({"t": rows(spark, (1, "a"), (None, "n"))}, "none", pks={"t": ["k"]})
    assert store.commits().count() == 0


def test_diff_from_the_log(spark, store):
    ids = [store.commit({"t": rows(spark, (1, "a"), (2, "b"), (3, "c")), "u": rows(spark, (1, "x"))}, "0", pks={"t": ["k"], "u": ["k"]})]
    ids.append(store.commit({"t": rows(spark, (1, "A"), (2, "b"), (3, "c"))}, "1"))
    ids.append(store.commit({"t": rows(spark, (1, "a"), (2, "b"))}, "2"))
    kinds = lambda a, b: {(r.old_key, r.new_key, r.change_type) for r in store.diff("t", a, b).collect()}
    # Row 1 was changed and changed back: it is in the log, but no difference.
    assert kinds(ids[0], ids[2]) == {(3, None, "delete")}
    assert kinds(ids[2], ids[0]) == {(None, 3, "insert")}
    assert kinds(ids[1], ids[2]) == {(1, 1, "update"), (3, None, "delete")}
    assert store.diff("u", ids[0], ids[2]).count() == 0
    plan = store.diff("t", ids[0], ids[2])._jdf.queryExecution().toString()
    assert "cut-" in plan  # only the keys of the log are looked up


def test_snapshots_are_counted_per_dataset(spark, store, monkeypatch):
    monkeypatch.setattr("tidemark.store.SNAPSHOT_EVERY", 2)
    store.commit({"t": rows(spark, (1, "a")), "u": rows(spark, (1, "x"))}, "0", pks={"t": ["k"], "u": ["k"]})
    for n in range(3):
        store.commit({"u": rows(spark, (1, f"x{n}"))}, f"u{n}")
    store.commit({"t": rows(spark, (1, "b"))}, "t")
    for name in "tu":
        assert store._exists(f"{store.root}/data/{store.version(name, 'main').slot}/snapshots")
    assert content(store.read("t", "main")) == [(1, "b")] and content(store.read("u", "main")) == [(1, "x2")]


def delta_of(spark, *changes, schema="k long, v string"):
    """(old row, new row) pairs as a delta frame."""
    return spark.createDataFrame([(a, b) for a, b in changes], f"old struct<{schema.replace(' ', ':').replace(',:', ',')}>, new struct<{schema.replace(' ', ':').replace(',:', ',')}>")


def test_commit_of_a_diff_equals_that_of_the_table(spark, tmp_path):
    many = [(i, f"v{i}") for i in range(500)]
    whole, part = (VersionStore(spark, str(tmp_path / n)) for n in ("whole", "part"))
    for s in (whole, part):
        s.commit({"t": rows(spark, *many)}, "one", pks={"t": ["k"]})
    after = [(1, "one"), *[m for m in many if m[0] not in (1, 2)], (1000, None)]
    whole.commit({"t": rows(spark, *after)}, "two")
    part.commit_delta("t", delta_of(spark, ((1, "v1"), (1, "one")), ((2, "v2"), None), (None, (1000, None))), "two")
    assert content(part.read("t", "main")) == content(whole.read("t", "main"))
    a, b = part.version("t", "main"), whole.version("t", "main")
    assert (a.checksum, a.row_count) == (b.checksum, b.row_count) and a.row_count == 500
    kinds = {(r.old_key, r.new_key): r.change_type for r in part.diff("t", "main^", "main").collect()}
    assert kinds == {(1, 1): "update", (2, None): "delete", (None, 1000): "insert"}
    assert content(part._sums(a)) == content(whole._sums(b))


def test_commit_of_a_diff_must_fit(spark, store):
    store.commit({"t": rows(spark, (1, "a"), (2, "b"), (3, "c"))}, "one", pks={"t": ["k"]})
    for change in (((1, "x"), (1, "y")), ((9, "z"), None), (None, (2, "b")), ((7, "a"), (8, "a"))):
        with pytest.raises(DoesNotFit):
            store.commit_delta("t", delta_of(spark, change), "bad")
    with pytest.raises(InvalidRows):
        store.commit_delta("t", delta_of(spark, (None, (5, "a")), (None, (5, "b"))), "twice")
    with pytest.raises(NoChanges):
        store.commit_delta("t", delta_of(spark, ((1, "a"), (1, "a"))), "same")
    with pytest.raises(NoChanges):
        store.commit_delta("t", delta_of(spark).limit(0), "empty")
    with pytest.raises(ValueError):
        store.commit_delta("t", delta_of(spark, ((1, "a", 2), None), schema="k long, v string, w long"), "columns")
    assert store.commits().count() == 1
    # A key changes hands: 2 moves to 4, 3 moves to 2.
    store.commit_delta("t", delta_of(spark, ((2, "b"), (4, "b")), ((3, "c"), (2, "c"))), "moves")
    assert content(store.read("t", "main")) == [(1, "a"), (2, "c"), (4, "b")]
    store.commit_delta("t", None, "title", meta={"title": "T"})
    assert store.version("t", "main").meta == {"title": "T"} and content(store.read("t", "main")) == [(1, "a"), (2, "c"), (4, "b")]


def test_rename_refuses_clashes(spark, store):
    store.commit({"t": rows(spark, (1, "a")), "u": rows(spark, (1, "a"))}, "one", pks={"t": ["k"], "u": ["k"]})
    for wrong in ("u", "U", "bad:name", ""):
        with pytest.raises(ValueError):
            store.rename("t", wrong, "no")
    with pytest.raises(KeyError):
        store.rename("missing", "x", "no")
    with pytest.raises(DoesNotFit):
        store.rename("t", "x", "no", dirty=spark.createDataFrame([("1",)], "pk string"))
    before = store.version("t", "main")
    store.rename("t", "x/y", "moved")
    assert {r.path for r in store.datasets("main").collect()} == {"x/y", "u"} and content(store.read("x/y", "main")) == [(1, "a")]
    assert store.version("t", "main") is None and store.version("x/y", "main").slot == before.slot and content(store.read("t", "main^")) == [(1, "a")]


def test_workspace_commits(spark, store):
    from tidemark.operators import workspace

    base = rows(spark, (1, "a"), (2, "b"), (3, "c"))
    store.commit({"t": base}, "one", pks={"t": ["k"]})
    delta, dirty = delta_of(spark, ((1, "a"), (1, "A")), (None, (4, "d"))), spark.createDataFrame([("1",), ("3",), ("4",)], "pk string")
    delta = delta.withColumns({"old_key": F.col("old.k"), "new_key": F.col("new.k")})
    with pytest.raises(DoesNotFit):
        workspace.commit_edits(store, "t", delta, dirty, "no", clashes=delta.filter("new_key = 4"))
    assert store.commits().count() == 1
    left = workspace.commit_edits(store, "t", delta, dirty, "yes", clashes=delta.limit(0))
    assert content(left) == [("3",)] and content(store.read("t", "main")) == [(1, "A"), (2, "b"), (3, "c"), (4, "d")]
    for path, pk in (("n", []), ("n", ["zz"]), ("T", ["k"]), ("a//b", ["k"])):
        with pytest.raises(ValueError):
            workspace.add_untracked(store, path, base, pk, "no")
    with pytest.raises(InvalidRows):
        workspace.add_untracked(store, "n", rows(spark, (1, "a"), (1, "b")), ["k"], "twice")
    workspace.add_untracked(store, "n", base, ["k"], "add", meta={"title": "N"})
    assert store.version("n", "main").meta == {"title": "N"} and store.read("n", "main").count() == 3


def test_diffs_of_compound_keys_and_snapshots(spark, store, monkeypatch):
    monkeypatch.setattr("tidemark.store.SNAPSHOT_EVERY", 4)
    schema = "k long, g string, v string"
    store.commit({"t": rows(spark, (1, "x", "a"), (1, "y", "b"), schema=schema)}, "one", pks={"t": ["k", "g"]})
    for i in range(4):
        store.commit_delta("t", delta_of(spark, (None, (i + 10, "x", str(i))), schema=schema), f"c{i}")
    assert store.read("t", "main").count() == 6 and store.version("t", "main").row_count == 6
    assert spark.read.parquet(f"{store.root}/data/{store.version('t', 'main').slot}/snapshots").count() == 5
    store.commit_delta("t", delta_of(spark, ((1, "x", "a"), None), schema=schema), "gone")
    assert (1, "x", "a") not in content(store.read("t", "main")) and store.read("t", "main").count() == 5


def test_few_touched_keys_read_few_rows(spark, store):
    store.commit({"t": spark.range(200_000).selectExpr("id AS k", "CAST(id AS STRING) AS v").repartition(8)}, "one", pks={"t": ["k"]})
    v = store.version("t", "main")
    some = store._rows_at(v, store.resolve("main"), rows(spark, (5, "5"), (77, "77")).select("k"))
    assert content(some) == [(5, "5"), (77, "77")]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(_bucket" in plan or "In(_bucket" in plan
    # Files hold ranges of buckets: those of two keys lie in two of them at most.
    files = spark.read.parquet(f"{store.root}/data/{v.slot}/changes").selectExpr("_bucket", "input_file_name() AS f")
    ends = files.groupBy("f").agg(F.min("_bucket"), F.max("_bucket")).orderBy("min(_bucket)").collect()
    assert all(x[2] < y[1] for x, y in zip(ends, ends[1:]))


def test_estimates_from_stored_sums(spark, store):
    store.commit({"t": spark.range(20_000).selectExpr("id AS k", "id % 7 AS v")}, "one", pks={"t": ["k"]})
    store.commit({"t": spark.range(20_000).selectExpr("id AS k", "CASE WHEN id % 10 = 0 THEN 99 ELSE id % 7 END AS v")}, "two")
    store.commit_delta("t", delta_of(spark, ((5, 5), (5, 50)), ((8, 1), None), schema="k long, v long"), "three")
    few = store.estimate("t", "main^", "main").first()
    assert (few.estimate, few.exact) == (2, True)
    many = store.estimate("t", "main~2", "main", "good").first()
    assert not many.exact and abs(many.estimate - 2002) < 500
    assert store.estimate("t", "main", "main").first().estimate == 0


def test_history_by_the_lanes_kept_with_the_commits(spark, store):
    one = store.commit({"t": rows(spark, (1, "a"), (2, "b"))}, "one", pks={"t": ["k"]})
    store.move_ref("side", one)
    # The side line is the first to go on from commit one, so the main line opens a lane.
    side = store.commit({"t": rows(spark, (2, "b"))}, "side", ref="side")
    two = store.commit({"t": rows(spark, (1, "A"), (2, "b"), (3, "c"))}, "two")
    three = store.commit({"t": rows(spark, (1, "x"), (3, "c"))}, "three", parents=[two, side])
    place = {r.commit_id: (r.ups, r.lane, r.up_lane, r.fork_seq) for r in store.commits().collect()}
    assert place == {one: ([], 0, None, None), side: ([0], 0, None, None), two: ([0], 2, 0, 0), three: ([2, 1], 2, 0, 0)}
    assert {r.commit_id: (r.inserts, r.updates, r.deletes) for r in store.change_counts("t").collect()} == {
        one: (2, 0, 0), side: (0, 0, 1), two: (1, 1, 0), three: (0, 1, 1)
    }
    assert {r.commit_id: r.refs for r in store.log("main").collect()} == {one: None, side: "side", two: None, three: "main"}
    assert {r.commit_id for r in store.log("side").collect()} == {one, side}
    keys = spark.createDataFrame([(1,), (9,)], "k long")
    lines = [(r.commit_id, r.change_type, r.old and r.old.v, r.new and r.new.v) for r in store.row_history("t", keys).orderBy("seq").collect()]
    assert lines == [(one, "insert", None, "a"), (two, "update", "a", "A"), (three, "update", "A", "x")]
    assert store.row_history("t", keys, "side").filter("change_type = 'delete'").first().old.v == "a"
    assert store.resolve("main~2") == one and store.resolve("main^") == two
    with pytest.raises(KeyError):
        store.resolve("main~3")
    again = VersionStore(spark, store.root)
    assert content(again.read("t", "main~1")) == [(1, "A"), (2, "b"), (3, "c")]


def test_wider_type_is_read_from_narrower_files(spark, store):
    store.commit({"t": rows(spark, (1, 5), (2, 6), schema="k long, n int")}, "int", pks={"t": ["k"]})
    store.commit({"t": rows(spark, (1, 5), (2, 1 << 40), schema="k long, n long")}, "long")
    assert content(store.read("t", "main")) == [(1, 5), (2, 1 << 40)]
    assert content(store.read("t", "main^")) == [(1, 5), (2, 6)]
    assert content(store.diff("t", "main^", "main").select("change_type", "new.n")) == [("update", 1 << 40)]
    assert content(store.change_counts("t").select("seq", "inserts", "updates")) == [(0, 2, 0), (1, 0, 1)]


def test_snapshots_and_diffs_of_an_empty_dataset(spark, store, monkeypatch):
    monkeypatch.setattr("tidemark.store.SNAPSHOT_EVERY", 2)
    store.commit({"t": rows(spark)}, "none", pks={"t": ["k"]})
    store.commit({"t": rows(spark, (1, "a"))}, "one")
    store.commit({"t": rows(spark)}, "none again")
    store.commit({"t": rows(spark, (2, "b"))}, "another")
    assert [content(store.read("t", f"main~{n}")) for n in range(4)] == [[(2, "b")], [], [(1, "a")], []]
    assert content(store.diff("t", "main~2", "main").select("change_type")) == [("delete",), ("insert",)]
