import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs, typed

SCHEMA = "dataset string, key bigint, seq bigint, op string, edit bigint, at timestamp"


def arrive(spark, folder, rows):
    frame = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    frame.withColumn("at", F.timestamp_seconds(F.col("seq") * 86400)).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, delay="100 days", known=None):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    jobs.annotate_changes(stream, "at", str(tmp_path / "out"), str(tmp_path / "progress"), delay, "edit", known)
    return {(r.seq, r.dataset): (r.inserts, r.updates, r.deletes, r.late) for r in jobs.annotations(spark, str(tmp_path / "out")).collect()}


def brute_force(rows):
    last, counts = {}, {}
    for dataset, key, seq, op, edit in rows:
        if seq is not None and edit >= last.get((dataset, key, seq), (None, -1))[1]:
            last[dataset, key, seq] = (op, edit)
    alive = {}
    for dataset, key, seq in sorted(last, key=lambda k: k[2]):
        put, was = last[dataset, key, seq][0] != "del", alive.get((dataset, key), False)
        if put or was:
            at = 2 if not put else 1 if was else 0
            counts.setdefault((seq, dataset), [0, 0, 0, 0])[at] += 1
        alive[dataset, key] = put
    return {k: tuple(v) for k, v in counts.items()}


def test_commits_in_any_order_over_runs(spark, tmp_path):
    dice = random.Random(3)
    rows = [(dice.choice("ab"), dice.choice([1, 2, 3, None]), dice.randrange(1, 12), dice.choice(["put", "put", "del"]), i) for i in range(120)]
    rows += [("a", 1, None, "put", 500)]
    dice.shuffle(rows)
    got = None
    for part in (rows[:50], rows[50:90], rows[90:] + rows[:10]):  # the last run brings ten edits again
        arrive(spark, str(tmp_path / "in"), part)
        got = run(spark, tmp_path)
    assert got == brute_force(rows)


def test_batch_that_fails_is_counted_once(spark, tmp_path, monkeypatch):
    first, second = [("a", 1, 1, "put", 1), ("a", 2, 1, "put", 2)], [("a", 1, 2, "del", 3), ("a", 2, 3, "put", 4)]
    arrive(spark, str(tmp_path / "in"), first)
    run(spark, tmp_path)
    arrive(spark, str(tmp_path / "in"), second)

    def half_done(stream, write, checkpoint, available_now=True):
        def fail(batch, batch_id):
            write(batch, batch_id)
            raise RuntimeError("executor lost")

        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fail).trigger(availableNow=True).start()
        query.awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(jobs, "_run", half_done)
        with pytest.raises(Exception, match="executor lost"):
            run(spark, tmp_path)
    assert run(spark, tmp_path) == brute_force(first + second)


def test_known_commits_shape_the_rest_unreported(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [("a", 1, 1, "put", 1), ("a", 1, 2, "put", 2), ("a", 1, 3, "del", 3)])
    known = spark.createDataFrame([(1,), (1,)], "seq bigint")
    assert run(spark, tmp_path, known=known) == {(2, "a"): (0, 1, 0, 0), (3, "a"): (0, 0, 1, 0)}


def test_change_behind_the_watermark_is_reported_late(spark, tmp_path):
    runs = [(1, "put", 1), (50, "put", 2)], [(60, "put", 3)], [(65, "put", 6)], [(20, "del", 4), (70, "del", 5)]
    for edits in runs:  # commit 50 is folded in the third run, so the place of 20 is gone in the fourth
        rows = [("a", 1, *e) for e in edits]
        arrive(spark, str(tmp_path / "in"), rows)
        got = run(spark, tmp_path, "5 days")
    assert got == {(1, "a"): (1, 0, 0, 0), (50, "a"): (0, 1, 0, 0), (60, "a"): (0, 1, 0, 0), (65, "a"): (0, 1, 0, 0), (20, "a"): (0, 0, 0, 1), (70, "a"): (0, 0, 1, 0)}


def test_folding_keeps_later_types():
    entries = {1: (0, 10, True), 2: (0, 30, False), 3: (0, 20, True)}
    before = typed.change_types(False, dict(entries))
    floor, alive = typed.fold(None, False, entries, 25)
    assert (floor, alive, sorted(entries)) == (1, True, [2, 3])  # 3 is old, but 2 before it is not
    assert typed.change_types(alive, entries) == {s: k for s, k in before.items() if s > 1}


def test_one_call_takes_the_rows_of_a_group(spark, tmp_path):
    """More rows than groups: calls of the worker are bounded per batch, and no row's state mixes with another's."""
    keys = spark.range(3000).selectExpr("id AS key").crossJoin(spark.createDataFrame([(1, "put"), (2, "put"), (3, "del")], "seq bigint, op string"))
    rows = keys.selectExpr("if(key % 2 = 0, 'a', NULL) AS dataset", "key", "seq", "op", "key * 4 + seq AS edit", "timestamp_seconds(seq * 86400) AS at")
    rows.write.parquet(str(tmp_path / "in"))
    out = run(spark, tmp_path)
    assert out == {(seq, d): tuple(1500 * (seq == k) for k in (1, 2, 3)) + (0,) for seq in (1, 2, 3) for d in ("a", None)}
    stream = typed.typed_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "at", "100 days", "edit")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert f"cast({typed.GROUPS} as bigint)" in plan or f", {typed.GROUPS}" in plan


def test_keys_of_other_types_come_back_as_they_were(spark, tmp_path):
    kinds = {"string": "concat('k', id, if(id = 3, ' ', ''))", "timestamp": "timestamp_micros(1700000000000000 + id)", "binary": "unhex(hex(id * 77 + 200))", "double": "if(id = 1, double('NaN'), id / 3)", "date": "date_add(date'2024-01-01', cast(id AS int))"}
    for kind, made in kinds.items():
        folder = str(tmp_path / kind)
        rows = spark.range(5).selectExpr("'a' AS dataset", f"if(id = 4, NULL, {made}) AS key", "id AS seq", "'put' AS op", "id AS edit", "timestamp_seconds(id * 86400) AS at")
        rows.write.parquet(folder)
        got = []
        stream = typed.typed_stream(spark.readStream.schema(rows.schema).parquet(folder), "at", "100 days", "edit")
        jobs._run(stream, lambda batch, _: got.extend((r.seq, r.key, r.change_type, r.n) for r in batch.collect()), str(tmp_path / f"{kind}-progress"))
        want = [(r.seq, r.key, "insert", 1) for r in rows.collect()]
        assert repr(sorted(got)) == repr(sorted(want)), kind


def test_known_commits_are_read_once(spark, tmp_path):
    known = spark.range(5).selectExpr("id AS seq").filter("seq * 2 = 4")
    rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    plan = typed.typed_stream(rows, "at", "100 days", "edit", known)._jdf.queryExecution().analyzed().toString()
    assert "Range" not in plan
