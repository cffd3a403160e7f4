"""Distributed positions against brute force, with hot groups and tiny buckets."""

import random

from pyspark.sql import functions as F

from tidemark.operators import numbering


def test_rank_in_group_with_hot_group(spark):
    rnd = random.Random(1)
    keys = rnd.sample(range(100000), 900)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice("abc"), k) for k in keys]
    got = {(r.g, r.k): r.rank for r in numbering.rank_in_group(spark.createDataFrame(rows, "g string, k long"), ["g"], "k", stride=64).collect()}
    for g in {r[0] for r in rows}:
        for i, k in enumerate(sorted(k for h, k in rows if h == g), 1):
            assert got[(g, k)] == i


def test_offset_before(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 7).alias("n"))
    total = 0
    for r in sorted(numbering.offset_before(df, "h", "n").collect(), key=lambda r: r.h):
        assert r.offset == total
        total += r.n


def test_number_all(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.position == r.k + 1 for r in numbering.number_all(df, ["k"], parts=7).collect())


def test_expand(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 3)], "k string, n long")
    got = sorted((r.k, r.copy) for r in numbering.expand(df, "n", chunk=4).collect())
    assert got == [("a", i) for i in range(10)] + [("c", i) for i in range(3)]


def test_previous_across_buckets(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else "cold", s, rnd.choice([None, "x", "y"])) for i, s in enumerate(rnd.sample(range(5000), 300))]
    got = {(r.g, r.s): r.prev_v for r in numbering.previous(spark.createDataFrame(rows, "g string, s long, v string"), ["g"], "s", ["v"], stride=50).collect()}
    for g in ("hot", "cold"):
        last = None
        for s, v in sorted((s, v) for h, s, v in rows if h == g):
            assert got[(g, s)] == last
            last = v
