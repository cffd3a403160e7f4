"""Secret scans: candidate strings by form, false positives removed by a random forest in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Shortest run of key characters that is looked at.
LEAST = 16
CANDIDATE = rf"[A-Za-z0-9_+/\-]{{{LEAST},}}"
#: Text kept on either side of a candidate.
BEFORE, AFTER = 48, 24
#: Findings the forest is fitted on, at most so many of each label.
SAMPLE = 2000
#: Words of the dictionary, the most frequent ones near candidates, and in how many places they must stand.
DICTIONARY, LEAST_SEEN = 20_000, 5
TREES, DEPTH, LEAF = 40, 8, 3
#: Names that credentials are given to (fixed value).
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")
#: Features of a candidate, in this order.
FEATURES = (
    "length", "digits", "lowers", "uppers", "others", "hex", "class_changes", "same_char", "repeats", "entropy", "vowel_steps", "dictionary",
    "longest_letters", "slashes", "in_path", "has_suffix", "assigned", "quoted", "named", "word_before", "word_after", "mail",
)

_PATTERN = re.compile(CANDIDATE)
_NAMED = re.compile(r"(?i)(" + "|".join(NAMES) + r")[\"' ]*[:=]?[\"' ]*$")


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, per candidate, start (characters before it), value, before and after.

    Texts without a run of key characters are left out in the JVM; NULL and empty texts have none.
    """
    rows = docs.select(*keep, "text").where(F.col("text").rlike(CANDIDATE))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, value, before, after = [], [], [], [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                for m in _PATTERN.finditer(text):
                    row.append(i)
                    start.append(m.start())
                    value.append(m.group())
                    before.append(text[max(0, m.start() - BEFORE) : m.start()])
                    after.append(text[m.end() : m.end() + AFTER])
            columns = [batch.column(k).take(pa.array(row, pa.int32())) for k in range(len(keep))]
            columns += [pa.array(start, pa.int64()), *(pa.array(x, pa.string()) for x in (value, before, after))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "start", "value", "before", "after"])

    return rows.mapInArrow(run, f"{kept}, start bigint, value string, before string, after string")


def covered(value: str, words: frozenset[str]) -> float:
    """Share of the characters of ``value`` that the longest words of the dictionary cover, from left to right."""
    text, i, hit = value.lower(), 0, 0
    while i < len(text):
        for n in range(min(10, len(text) - i), 2, -1):
            if text[i : i + n] in words:
                hit += n
                i += n
                break
        else:
            i += 1
    return hit / len(text)


def describe(value: str, before: str, after: str, words: frozenset[str]) -> list[float]:
    """The features of one candidate."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value]
    counts = {c: value.count(c) for c in set(value)}
    low = value.lower()
    vowels = [c in "aeiouy" for c in low]
    left, right = re.findall(r"[^\W\d_]+", before), re.findall(r"[^\W\d_]+", after)
    last = before[-1:] or " "
    return [
        float(n), kinds.count("d") / n, kinds.count("l") / n, kinds.count("u") / n, kinds.count("o") / n, sum(c in "0123456789abcdef" for c in low) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(a == b for a, b in zip(value, value[1:])) / n, 1 - len({value[i : i + 3] for i in range(n - 2)}) / max(1, n - 2),
        -sum(k / n * np.log2(k / n) for k in counts.values()), sum(a != b for a, b in zip(vowels, vowels[1:])) / n, covered(value, words),
        float(max(map(len, re.findall(r"[A-Za-z]+", value)), default=0)), float(value.count("/")), float(last in "/\\.~"), float(bool(re.match(r"\.[A-Za-z]{1,4}\b", after))),
        float(last in "=:" or before.rstrip("\"' ")[-1:] in ("=", ":")), float(last in "\"'" and after[:1] in "\"'" and bool(after)), float(bool(_NAMED.search(before))),
        float(bool(left) and left[-1].lower() in words), float(bool(right) and right[0].lower() in words), float(after[:1] == "@" or last == "@"),
    ]


class Forest:
    """Trees grown on bootstrap samples, each split chosen among a few random features by Gini impurity."""

    def __init__(self, trees: list[dict[str, np.ndarray]]) -> None:
        self.trees = trees

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Forest:
        rng = np.random.default_rng(seed)
        return Forest([Forest._tree(x, y, rng.integers(0, len(x), len(x)), rng) for _ in range(TREES)])

    @staticmethod
    def _tree(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        feature, bound, below, share = [-1], [0.0], [-1], [float(y[rows].mean())]
        open_nodes = [(0, rows, 0)]
        while open_nodes:
            node, rows, depth = open_nodes.pop()
            mine = y[rows]
            if depth == DEPTH or len(rows) < 2 * LEAF or mine.all() or not mine.any():
                continue
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, hits = x[rows[order], f], np.cumsum(mine[order])
                n = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(rows) - n >= LEAF)
                if not ok.any():
                    continue
                a, b = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(rows) - n)
                impure = np.where(ok, n * a * (1 - a) + (len(rows) - n) * b * (1 - b), np.inf)
                at = int(impure.argmin())
                best = min(best, (float(impure[at]), int(f), float((v[at] + v[at + 1]) / 2)))
            if best[1] < 0:
                continue
            feature[node], bound[node], below[node] = best[1], best[2], len(feature)
            side = x[rows, best[1]] <= best[2]
            for part in (rows[side], rows[~side]):
                open_nodes.append((len(feature), part, depth + 1))
                feature.append(-1)
                bound.append(0.0)
                below.append(-1)
                share.append(float(y[part].mean()))
        return {"feature": np.array(feature), "bound": np.array(bound), "below": np.array(below), "share": np.array(share)}

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = t["feature"][at]
                deeper = f >= 0
                side = x[np.arange(len(x)), np.maximum(f, 0)] > t["bound"][at]
                at = np.where(deeper, t["below"][at] + side, at)
            total += t["share"][at]
        return total / max(1, len(self.trees))


def dictionary(found: DataFrame) -> frozenset[str]:
    """The most frequent words that stand near candidates, at most ``DICTIONARY`` of three letters or more."""
    near = found.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w"))
    top = near.groupBy("w").count().where(F.col("count") >= LEAST_SEEN).orderBy(F.desc("count"), "w").limit(DICTIONARY)
    return frozenset(r.w for r in top.collect())


def fit(findings: DataFrame, words: frozenset[str], seed: int = 1) -> Forest:
    """A forest from labelled findings (value, before, after, secret), at most ``SAMPLE`` of each label by least hash."""
    columns = ["value", "before", "after", "secret"]
    parts = [findings.where(F.col("secret") == k).orderBy(F.xxhash64(*columns), *columns).limit(SAMPLE).select(*columns) for k in (True, False)]
    rows = [r for part in parts for r in part.collect()]
    if not rows:
        return Forest([])
    return Forest.grow(np.array([describe(r.value, r.before, r.after, words) for r in rows]), np.array([r.secret for r in rows], dtype=float), seed)


def judge(found: DataFrame, forest: Forest, words: frozenset[str], threshold: float = 0.5) -> DataFrame:
    """``found`` (with value, before, after) with score and secret; without training findings nothing is removed."""
    sent = found.sparkSession.sparkContext.broadcast((forest, words))
    names = found.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, words = sent.value
        at = [names.index(c) for c in ("value", "before", "after")]
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in at)))
            x = np.array([describe(*r, words) for r in rows]).reshape(len(rows), len(FEATURES))
            score = forest.score(x) if forest.trees else np.ones(len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= threshold)], names=[*names, "score", "secret"])

    return found.mapInArrow(run, f"{kept}, score double, secret boolean")


def plain_label(value: Column, before: Column, after: Column) -> Column:
    """What can be told of a candidate by rule alone: true, false, or NULL where rules do not tell.

    Keys of a known issuer and values given to a credential's name, of mixed digits and
    letters, are secrets; words, numbers, parts of addresses and of paths are not.
    """
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    issued = value.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$")
    named = before.rlike(r"(?i)(" + "|".join(NAMES) + r")[\"' ]*[:=][\"' ]*$")
    harmless = value.rlike(r"^[a-z]+$|^[A-Z]?[a-z]+$|^[0-9]+$|^[A-Z]+$") | after.startswith("@") | before.endswith("@") | before.endswith("/")
    return F.when(issued | (named & mixed), F.lit(True)).when(harmless, F.lit(False))


def scan(docs: DataFrame, findings: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidates of all texts with the forest's verdict: ``keep``, start, value, before, after, score, secret.

    ``findings`` (value, before, after, secret) are labelled by people or another tool; without
    them the forest learns from those candidates that rules can label, and generalises to the rest.
    """
    found = cut(candidates(docs, keep))
    words = dictionary(found)
    if findings is None:
        labelled = found.withColumn("secret", plain_label(F.col("value"), F.col("before"), F.col("after")))
        findings = labelled.where("secret IS NOT NULL").select("value", "before", "after", "secret").distinct()
    return judge(found, fit(findings, words), words)
