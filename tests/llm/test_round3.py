"""Spelling variants, exact top-k and the Merkle manifest against brute force and on hard rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import HARD, docs
from tidemark.llm import impact, manifest, spelling

# --- spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts: dict[str, int]) -> dict[str, tuple]:
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {a: min(near[a], key=lambda b: (-counts[b], b), default=None) for a in counts}
    form = {a: b if b is not None and counts[b] >= 2 * counts[a] else None for a, b in form.items()}

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {a: (form[a], root(a), counts[a], len(near[a]), counts.get(form[a])) for a in counts}


@pytest.mark.parametrize("shard_words", [8, 64, 32768])
def test_forms_equal_brute_force(spark, shard_words):
    """Small indexes split keys of many words; either size must give the same pairs."""
    r = random.Random(5)
    counts = {"".join(r.choice("abéß") for _ in range(r.randint(5, 9))): r.choice([3, 4, 7, 20, 50, 200]) for _ in range(300)}
    counts |= {"aaaaa": 9, "aaaaaa": 30, "aaaaaaa": 100, "x" * 3000: 5, "x" * 2999 + "y": 12}
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.forms_of(rows, shard_words=shard_words).collect()}
    assert got == brute_forms(counts)


def test_suffix_index_reads_every_edit():
    r = random.Random(3)
    for _ in range(10):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(150)})
        found = set()
        for turn in (lambda w: w, lambda w: w[::-1]):
            index = spelling.SuffixIndex([turn(w) for w in words])
            exact = np.array([len(w) // 2 if turn(w) == w else -(-len(w) // 2) for w in words])
            for p, w in zip(*index.near([turn(x) for x in words], exact)):
                found.add((words[p], words[w]))
        assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_with_slips(spark):
    text = "Straße naïve, élan-vital Mississippi don't ÀÉÎ abcde x1y2 " * 3
    rows = [(i, text, "en", "a") for i in range(40)] + [(None, "Orphans orphans ORPHANS", None, None)] + [(i, t, g, s) for i, t, g, s in HARD]
    counts: Counter = Counter()
    for i, t, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in spelling.words_of(docs(spark, rows), slips=97).collect()} == want
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(docs(spark, rows), slips=97).collect()}
    assert got == brute_forms(want)


def test_variants_of_nothing(spark):
    assert spelling.variants(docs(spark).limit(0)).count() == 0
    assert spelling.variants(docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "no 12 long ones", "en", "a")])).count() == 0
    with pytest.raises(ValueError):
        spelling.forms_of(spark.createDataFrame([("abcde", 3)], "word string, n bigint"), factor=1)


# --- exact top-k


def brute_top(rows, k=5):
    """Lists by query, as a multiset: ids may repeat."""
    whole = [(i, [impact.whole(float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and abs(float(x)) < float("inf") for x in v)]
    out = []
    for a, (q, v) in enumerate(whole):
        if q is not None and q % 2 == 0:
            near = sorted((-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(whole) if b != a)[:k]
            out += [(q, n + 1, None if none else i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, none, i) in enumerate(near)]
    return Counter(out)


def search(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id bigint, embedding array<float>, row int, shard int, score int")
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in impact.search(df, F.col("vec_id") % 2 == 0, **kw).collect())


@pytest.mark.parametrize("shard_rows", [40, 16384])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((150, 8)).astype(np.float32) / 3)]
    rows += [(200 + i, [0.25] * 8) for i in range(12)]  # copies: ties by id
    rows += [(300, None), (301, [0.5] * 7 + [None]), (302, [float("nan")] * 8), (304, [float("inf")] * 8), (306, [0.0] * 8), (308, []), (310, [0.5, 0.25]), (None, [0.5] * 8)]
    rows += [(10, [0.1] * 8), (10, [0.1] * 8)]  # an id three times
    assert search(spark, rows, shard_rows=shard_rows) == brute_top(rows)


def test_top_k_of_extreme_components(spark):
    rows = [(0, [3e38, -3e38]), (1, [3e38, 3e38]), (2, [1e30, 1.0]), (3, [-1e30, 5.0]), (4, [1e-40, 2.0]), (5, [1000.0, -1000.0]), (6, [0.5, 0.5]), (7, [0.5, -0.5])]
    assert search(spark, rows) == brute_top(rows)


def test_top_k_of_few_rows(spark):
    assert search(spark, []) == Counter() and search(spark, [(2, [1.0])]) == Counter()
    assert search(spark, [(2, [1.0]), (3, [0.5])]) == Counter([(2, 1, 3, 256 * 128)])


def test_index_stops_early_with_proof():
    """Rows in groups: the best stand out, so postings are left unread and few rows are scored again."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((50, 32)) * 60
    table = np.floor(centres[rng.integers(50, size=4000)] + rng.standard_normal((4000, 32)) * 8).astype(np.int64)
    index = impact.ImpactIndex(table)
    for q in table[::400]:
        rows, scores = index.best(q, 6)
        assert sorted(scores)[-6:] == sorted(table @ q)[-6:]
    assert index.visited < 0.8 * 10 * table.size and index.rescored < 0.1 * 10 * len(table)


# --- Merkle manifest


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves: list[str], fanout: int):
    """Root, and per leaf its siblings level by level with its turn."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for way, p in zip(ways, at):
            run, turn = runs[p // fanout], p % fanout
            way.append(("".join(run[:turn] + run[turn + 1 :]), turn))
        at = [p // fanout for p in at]
        nodes = [H("".join(run)) for run in runs]
    return nodes[0], ways


def leaf_text(values) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows, fanout, change):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in groups:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_text(r)))
        trees[g] = (mine, *brute_tree([leaf_text(r) for r in mine], fanout))
    root, ways = brute_tree([trees[g][1] for g in groups], fanout)
    for g, upper in zip(groups, ways):
        mine, subroot, lower = trees[g]
        for r, way in zip(mine, lower):
            cur = leaf_text((*r[:4], change(r)))
            for beside, turn in way + upper:
                cur = H(beside[: turn * 64] + cur + beside[turn * 64 :])
            out.append((r[0], leaf_text(r), subroot, root, H("".join(b for b, _ in way + upper)), cur, cur == root))
    return Counter(out)


@pytest.mark.parametrize(("levels", "fanout", "n"), [(1, 2, 37), (2, 3, 100), (4, 8, 75), (1, 8, 600)])
def test_manifest_equals_brute_force(spark, levels, fanout, n):
    r = random.Random(n)
    rows = [(i, f"s{i % 3}", r.choice(["de", "en", "en", "en", "fr"]), i, f"Text {i} é") for i in range(n)] + [(1, None, None, None, None), (7, "s", "zz", 1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    change = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = Counter(tuple(x) for x in manifest.manifest(df, changed=change, levels=levels, fanout=fanout).collect())
    assert got == brute_manifest(rows, fanout, lambda x: x[4].lower() if x[4] and x[0] % 3 == 0 else x[4])


def test_manifest_of_hard_rows(spark):
    rows = [(i, s, g, None if t is None else len(t), t) for i, t, g, s in HARD]
    got = Counter(tuple(x) for x in manifest.manifest(docs(spark)).collect())
    assert got == brute_manifest(rows, 8, lambda x: x[4]) and all(x[-1] for x in got)
    assert manifest.manifest(docs(spark).limit(0)).count() == 0
    one = manifest.manifest(docs(spark, [(5, "a", "en", "s")])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("")


def test_appended_witnesses_grow():
    """A leaf's witness is extended as runs end, and folds to the root of what was appended."""
    leaves = [H(str(i)) for i in range(20)]
    tree = manifest.Appender(manifest.height(20, 4), 4)
    sizes = []
    for x in leaves:
        tree.append(x)
        sizes.append(len(tree.sides[0]))
    assert sizes == [0] * 3 + [1] * 12 + [2] * 5
    root = tree.close()
    assert root == brute_tree(leaves, 4)[0]
    assert all(manifest.fold(x, s, t) == root for x, s, t in zip(leaves, tree.sides, tree.turns))
