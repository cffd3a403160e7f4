import random
from collections import Counter

from tidemark.functions.hashing import text_content_id
from tidemark.operators import keygen


def test_assign_keys_is_a_multiset_match(spark):
    rnd = random.Random(5)
    old = [(i + 1, "hot" if rnd.random() < 0.6 else rnd.choice("abcd")) for i in range(60)]
    new = ["hot" if rnd.random() < 0.6 else rnd.choice("bcdef") for _ in range(80)]
    key_map = spark.createDataFrame(old, "pk long, v string").select("pk", text_content_id(["v"]).alias("hash"))
    keyed = keygen.assign_keys(spark.createDataFrame([(v,) for v in new], "v string"), key_map, text_content_id(["v"]), stride=7).collect()
    assert Counter(r.v for r in keyed) == Counter(new)
    assert len({r.auto_pk for r in keyed}) == len(new)
    top = max(k for k, _ in old)
    for v, n in Counter(new).items():
        had = sorted(k for k, w in old if w == v)
        got = sorted(r.auto_pk for r in keyed if r.v == v)
        assert got[: min(n, len(had))] == had[: min(n, len(had))]
        assert all(k > top for k in got[len(had):])
    fresh = sorted(r.auto_pk for r in keyed if r.auto_pk > top)
    assert fresh == list(range(top + 1, top + 1 + len(fresh)))


def brute_pairs(old, new, old_cols, new_cols):
    def variants(row, cols):
        facts = [(c, row[i]) for i, c in enumerate(cols, 1)]
        yield frozenset(facts)
        for f in facts:
            yield frozenset(x for x in facts if x != f)

    buckets = {}
    for side, table, cols in ((0, old, old_cols), (1, new, new_cols)):
        for r in table:
            for v in variants(r, cols):
                buckets.setdefault(v, ([], []))[side].append(r[0])
    meets = {(a[0], b[0]) for a, b in buckets.values() if len(a) == 1 and len(b) == 1}
    by_old, by_new = Counter(a for a, _ in meets), Counter(b for _, b in meets)
    return {(a, b) for a, b in meets if by_old[a] == 1 and by_new[b] == 1}


def test_similar_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    for added in (False, True):
        cols = ["x", "y", "z"]
        new_cols = cols[:-1] if added else cols
        old = [(i, *[rnd.choice([None, 1, 2, 3]) for _ in cols]) for i in range(25)]
        new = [(100 + i, *[rnd.choice([None, 1, 2, 3, 4]) for _ in new_cols]) for i in range(25)]
        o = spark.createDataFrame(old, "k long, x int, y int, z int")
        n = spark.createDataFrame(new, "k long, " + ", ".join(f"{c} int" for c in new_cols))
        got = keygen.similar_pairs(o, n, "k", "k", {c: c for c in cols}, {c: c for c in new_cols}).collect()
        assert {(r.old_key, r.new_key) for r in got} == brute_pairs(old, new, cols, new_cols)


def test_usable_keys(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 5)], "a int, b int, c int")
    got = {r.column: r.usable for r in keygen.usable_keys(df, ["a", "b", "c"]).collect()}
    assert got == {"a": True, "b": False, "c": False}
