"""Operators against brute force, round trips and held-out rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import jaccard, permutation, pseudonyms, quality, secret_scan, shingles, toxicity, trie_bpe
from tidemark.llm.common import components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def texts_of(spark, n=200):
    return [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").limit(n).collect()]


def test_components(spark):
    pairs = [("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "z")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[k] for k in "abcd"} == {"a"} and {got["x"], got["y"]} == {"x"}
    assert {got[f"n{i:02}"] for i in range(41)} == {"n00"}


# --- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_index_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 0) for i in range(100)]
    rows += [(i, [1.0] * 8, 0) for i in range(100, 160)]  # a group of copies
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [1.0] * 7 + [None], 0), (203, [1.0] * 7 + [float("nan")], 0), (204, [1.0], 0), (None, [1.0] * 8, 0), (100, [1.0] * 8, 0), (205, [], 0)]
    df = vectors(spark, rows)
    got = {}
    for r in permutation.search(df, df.select("vec_id"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(160))
    assert [v for _, v, _ in sorted(got[130])] == [100, 101, 102, 103, 104]
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    # So few rows are all ranked: the result is exact.
    known = {i: np.array(v) for i, v, _ in rows if i is not None and i < 160}
    for q in (0, 50, 99):
        cos = {i: float(v @ known[q] / np.sqrt((v @ v) * (known[q] @ known[q]))) for i, v in known.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 9), i))[:5]
        assert [v for _, v, _ in sorted(got[q])] == best
        assert all(abs(cos[v] - s) < 1e-6 for _, v, s in got[q])


def test_index_without_rows(spark):
    df = vectors(spark, [(1, None, 0)])
    assert permutation.search(df, df.select("vec_id")).count() == 0
    two = vectors(spark, [(1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0)])
    assert [(r.query_id, r["rank"], r.vec_id) for r in permutation.search(two, two.select("vec_id")).orderBy("query_id").collect()] == [(1, 1, 2), (2, 1, 1)]


def test_index_with_repeated_ids_and_extreme_components(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (0, [0.0, 1.0], 1), (1, [1e200, 1e199], 0), (2, [1e-200, 3e-200], 0), (3, [-2e-308, 1e-310], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("query_id", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("name", F.lit("n"))
    distinct = sorted({(i, tuple(v)) for i, v, _ in rows})

    def cosine(a, b):
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    wanted = []
    for i, v in distinct:
        near = sorted((-round(cosine(v, w), 9), j) for j, w in distinct if (j, w) != (i, v))[:3]
        wanted += [(i, n + 1, j, -c) for n, (c, j) in enumerate(near)]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in permutation.search(df, df.select("vec_id"), k=3).collect()]
    assert sorted(got) == sorted(wanted)


def test_index_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([r.vec_id for r in rows])
    found: dict[int, set[int]] = {}
    for r in permutation.search(df, df.where("vec_id % 50 = 0").select("vec_id")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        cos = unit @ unit[q]
        cos[q] = -2
        hits.append(len(found[ids[q]] & set(ids[np.argsort(-cos)[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_footrule_files():
    rng = np.random.default_rng(2)
    pivots, v = rng.standard_normal((12, 5)), rng.standard_normal((40, 5))
    shard = permutation.Shard(v, pivots, 6)
    seen = permutation.orders(v / np.linalg.norm(v, axis=1)[:, None], pivots, 6)
    query = seen[3][:4]
    plain = [sum(abs((list(row).index(p) if p in row else 6) - i) for i, p in enumerate(query)) for row in seen]
    assert shard.footrule(query).tolist() == plain


# --- Jaccard


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    out = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                out[a].add(b)
                out[b].add(a)
    return out


def test_jaccard_against_brute_force_with_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # so that the group is dealt in pieces
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"v{r.randrange(50)}" for _ in range(60))) for i in range(20)] + [(200, rows[0][1]), (201, "a b"), (202, "a b"), (203, "")]
    truth = brute_links(rows)
    got = {r.doc_id: r for r in jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i].n_links for i in got} == {i: len(v) for i, v in truth.items()}
    assert all(got[j].class_id == got[i].class_id for i, v in truth.items() for j in v)
    assert got[203].class_id == 203 and got[202].class_id == 201


def test_least_matches_never_drops_what_may_reach():
    least = jaccard.least_matches(0.8, 1e-7)
    assert all(0 <= m < n for n, m in least.items()) and least[128] > least[64]


def test_shingle_hashes_follow_words():
    texts = ["a b c d e f", "  a\tb c\nd e  f ", "a b c d e", "x", "", None, "a b c d e f g" * 3]
    got = [h.tolist() for h in shingles.shingles(pa.array(texts), 5)]
    assert got[0] == got[1] and got[2] == got[0][:1] and len(got[3]) == 1 and got[4] == got[5] == []
    assert [h.tolist() for h in shingles.shingles(pa.array(["zz", *texts]).slice(1), 5)] == got


# --- encoding


def test_encoding_equals_the_library(spark):
    library, codec = Tokenizer.from_file(VOCABULARY), trie_bpe.Codec(trie_bpe.read_tables(VOCABULARY))
    r = random.Random(5)
    letters = "ab AB01'sdtré\n\t\x1c\x85\xa0 中文²½Ⅷ़ि̈😀👍🏽_-.,!ⁿ　​"
    texts = texts_of(spark) + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "a" * 5000, "", " ", "\n\n  y"]
    for text, ids in zip(texts, codec.encode(texts)):
        made = library.encode(text, add_special_tokens=False).ids
        assert made == ids and library.decode(made, skip_special_tokens=False) == codec.decode(ids)


def test_codec_forgets_without_changing(monkeypatch):
    monkeypatch.setattr(trie_bpe, "REMEMBERED", 3)
    codec = trie_bpe.Codec(trie_bpe.read_tables(VOCABULARY))
    first = [list(codec.encode([t]))[0] for t in ("one two three four five", "one two", "three")]
    assert [codec.decode(i) for i in first] == ["one two three four five", "one two", "three"]


# --- toxicity


def test_gradients():
    raw = [t.encode() for t in ["Hello world, this is trash", "fine ÉCOLE école", "x"]]
    w = toxicity.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert len(w.own) == 8  # case does not part words
    rows, text = w.windows()
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(3).items()}
    labels = np.array([1.0, 0.0, 1.0])

    def loss(q):
        z = toxicity.logits(w.inputs(q), rows, q).astype(float)
        return (np.log1p(np.exp(z)) - labels * z).mean()

    for k, (on, d) in toxicity.gradients(w, rows, labels, np.ones(3), p).items():
        full = np.zeros_like(p[k])
        full[on] = d
        at = np.unravel_index(np.abs(full).argmax(), full.shape)
        up, down = ({kk: v.copy() for kk, v in p.items()} for _ in range(2))
        up[k][at] += 0.01
        down[k][at] -= 0.01
        assert full[at] == pytest.approx((loss(up) - loss(down)) / 0.02, abs=2e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        raw = " ".join("abcdefghij"[i % 10] * (1 + i // 10) for i in range(n)).encode()
        w = toxicity.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        rows, text = w.windows()
        assert set(rows.ravel()) - {len(w.own)} == set(range(n)) and (text == 0).all() and len(text) >= 1


def test_held_out_accuracy():
    r = random.Random(1)
    bad = [f"{a}{b}" for a in ("zorv", "krul") for b in ("ak", "en", "is", "om", "ut")]

    def text(toxic):
        w = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 150))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad)
        return " ".join(w)

    labels = np.array([i % 3 == 0 for i in range(900)])
    texts = [text(t) for t in labels]
    model = toxicity.fit(texts[:700], labels[:700])
    score = toxicity.score_texts(pa.array(texts[700:]), model)
    assert ((score >= 0.5) == labels[700:]).mean() > 0.95
    # A long clean text does not hide one word at its very end.
    assert toxicity.score_texts(pa.array([" ".join(texts[1:400:3]) + " zorven"]), model)[0] > 0.5


# --- secrets


def test_forest_removes_false_positives(spark):
    r = random.Random(4)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(300):
        rows.append((hexa(32), "the token = ", " ends here", True))
        rows.append(("".join(r.choice(["over", "night", "water", "shed", "rain", "bow"]) for _ in range(5)), "we walked ", " by noon", False))
        rows.append((hexa(8) + "/" + hexa(12), "see file /", ".txt today", False))
    findings = spark.createDataFrame(rows, "value string, before string, after string, secret boolean")
    split = F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(4)) == 0
    words = frozenset(["over", "night", "water", "shed", "rain", "bow", "token", "walked"])
    forest = secret_scan.fit(findings.where(~split), words)
    out = secret_scan.judge(findings.where(split).withColumnRenamed("secret", "truth"), forest, words).collect()
    assert len(out) > 100 and np.mean([r.secret == r.truth for r in out]) > 0.97


# --- pseudonyms


def test_pseudonyms_are_permutations_within_the_format(spark):
    values = [f"2024-{m:02}-{d:02}" for m in (1, 2, 12) for d in range(1, 29)] + [f"10.0.{a}.{b}" for a in (0, 7) for b in range(60)]
    values += [f"555-{i % 99 + 1:02}-{i + 1:04}".replace("555", f"{i % 660 + 1:03}") for i in range(100)] + [f"user{i}@host.example.org" for i in range(100)]
    values += [f"+1 (212) 555-{i:04}" for i in range(100)]
    rows = [(i, f"one {v} two {v}.") for i, v in enumerate(values)]
    out = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key="k").collect()}
    made = {}
    for i, v in enumerate(values):
        m = re.fullmatch(r"one (.*) two (.*)\.", out[i])
        assert m and m[1] == m[2] and m[1] != v
        made[v] = m[1]
        assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", m[1])).count("9") == sum(c.isdigit() for c in v) or "." in v
    assert len(set(made.values())) == len(values)
    again = pseudonyms.pseudonymise(spark.createDataFrame([(1, "x " + values[0])], "doc_id bigint, text string"), key="other").first().text
    assert again != "x " + made[values[0]]


def test_cards_stay_valid_and_invalid_numbers_stay(spark):
    rows = [(1, "4111111111111111 and 4111-1111-1111-1111"), (2, "4111111111111112 999.1.1.1 31/04/2001 000-12-3456")]
    a, b = [r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key="k").orderBy("doc_id").collect()]
    plain, parted = a.split(" and ")
    assert plain == parted.replace("-", "") and plain != "4111111111111111"
    digits = [int(c) for c in reversed(plain)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert b == rows[1][1]


# --- quality


def test_outliers_per_group_against_numpy(spark):
    """The estimate in plain numpy on the same whole numbers gives the same verdicts."""
    rows = quality.features(quality.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).toPandas()
    got = {r.doc_id: (r.kept, r.distance) for r in quality.verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    rows = rows[~rows.base_failed]
    size = rows.groupby("own").own.transform("size")
    rows["grp"] = rows.own.where(size >= quality.LEAST_ROWS, "*")
    floors = np.array(quality.FLOORS, dtype=float)
    for _, part in rows.groupby("grp"):
        x = part[[f"x{i}" for i in range(1, 6)]].to_numpy(float)
        ranked = np.sort(x, axis=0)
        point = lambda q: ranked[int(np.ceil(q * len(x))) - 1]
        mean, low = point(0.5), np.diag(np.maximum(floors, 0.7413 * (point(0.75) - point(0.25))))
        for _ in range(quality.STEPS):
            d2 = (np.linalg.solve(low, (x - mean).T) ** 2).sum(axis=0)
            bins = np.floor(np.log(1 + d2) * 48)
            ahead = np.searchsorted(np.sort(bins), bins, side="left")
            core = x[ahead < quality.CORE * len(x)]
            mean = core.mean(axis=0)
            low = np.linalg.cholesky(quality.CONSISTENCY * ((core.T @ core) / len(core) - np.outer(mean, mean)) + np.diag(floors**2))
        d2 = (np.linalg.solve(low, (x - mean).T) ** 2).sum(axis=0)
        for i, d in zip(part.doc_id, d2):
            assert got[i][1] == pytest.approx(d, rel=1e-6, abs=1e-9) and got[i][0] == (d <= quality.CUTOFF)


# --- pipeline


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before kept, against plain Python where that says it all."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, state = docs.columns, docs
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        state = stage(spark, state, FOLDER).cache()
        kept.append((name, before, state.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == columns
    rules, lines, near, mixed, encoded = kept
    whole = {r.doc_id: r.text for r in rules[1]}
    assert all(whole[r.doc_id] == r.text for r in rules[2]) and len(rules[2]) < len(rules[1])
    assert all(set(r.text.split("\n")) <= set(whole[r.doc_id].split("\n")) for r in lines[2])
    links = brute_links([(r.doc_id, r.text) for r in near[1]])
    left = {r.doc_id for r in near[2]}
    seen: set[int] = set()
    for i in links:
        if i not in seen:
            group, queue = {i}, [i]
            while queue:
                queue += [j for j in links[queue.pop()] if j not in group and not group.add(j)]
            seen |= group
            assert len(group & left) == 1 and min(group) in left
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert words(mixed[2]) == pytest.approx(1.5 * words(mixed[1]), rel=0.1)
    library = Tokenizer.from_file(VOCABULARY)
    texts = {r.doc_id: r.text for r in encoded[1]}
    assert sorted(r.doc_id for r in encoded[2]) == sorted(r.doc_id for r in encoded[1])
    assert all(library.decode(r.ids, skip_special_tokens=False) == texts[r.doc_id] for r in encoded[2])
