"""Spelling variants by search schemes over a pair of suffix indexes.

Two words one edit apart agree on the first half of either one or on the rest of it. So each
word is sought twice: its first half is matched exactly from the left, and what follows is
extended with one error; then the same from the right. Both searches start at the mark that
delimits words, so each needs one of the two directions of the index: the suffixes of the
reversed words are read from left to right, those of the words from right to left. An
interval of suffix ranks stands for all places at which what was read so far occurs.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Words are runs of these characters; only A-Z have a lower case here.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least length and occurrences of a word, and how many times more frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: Words of one suffix index; words of one key above a quarter of it are dealt anew.
SHARD_WORDS = 32768
#: Patterns searched at once in a task, and places of the table their roots are dealt to.
PATTERNS, SALTS = 4096, 16
PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def runs_of(text: Column) -> Column:
    """The runs of letters of a text, with A-Z in lower case; none for NULL."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def with_slips(doc_id: Column, run: Column, one_in: int = 97) -> Column:
    """``run`` without one character where the checksum of ``<doc_id>:<run>`` says so (a NULL id is written as nothing)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


class SuffixIndex:
    """Suffix ranks of the text of all reversed words, with a mark before, between and after them.

    Words are distinct. A pattern is read from its left end: each character narrows the
    interval of ranks, from all suffixes that start with a mark on.
    """

    def __init__(self, words: list[str]):
        order = sorted(range(len(words)), key=lambda i: words[i][::-1])
        self.word = np.array(order, np.int64)
        n = len(order)
        text = "".join(words[i][::-1] for i in order)
        codes = np.frombuffer(text.encode("utf-32-le"), np.int32)
        self.letters = np.unique(codes)
        self.sigma = len(self.letters)
        lengths = np.array([len(words[i]) for i in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        size = int(starts[-1]) + 1
        # Marks are 0; each is its own symbol when suffixes are ordered, in the order of the words.
        symbols = np.zeros(size, np.int64)
        inside = np.ones(size, bool)
        inside[starts] = False
        symbols[inside] = np.searchsorted(self.letters, codes) + 1
        rank = np.where(inside, symbols + n, 0)
        rank[starts] = np.arange(n + 1)
        reach, longest = 1, int(lengths.max()) + 1
        while reach <= longest:
            after = np.zeros(size, np.int64)
            after[:-reach] = rank[reach:] + 1
            distinct, rank = np.unique(rank * (size + n + 2 + self.sigma) + after, return_inverse=True)
            if len(distinct) == size:
                break
            reach *= 2
        suffixes = np.argsort(rank)
        before = symbols[suffixes - 1]
        self.before = np.where(suffixes == 0, -1, before)  # the first mark has nothing before it
        self.width = size + 1
        held = np.flatnonzero(self.before >= 0)
        self.places = np.sort(self.before[held] * self.width + held)
        self.every = (0, n + 1)

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more character (0 the mark, -1 one that no word has)."""
        add = (c > 0).astype(np.int64)
        low, high = (np.searchsorted(self.places, c * self.width + x) + add for x in (low, high))
        return low, np.where(c < 0, low, high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, character) for each letter that can follow each interval."""
        wide = np.flatnonzero(high - low > self.sigma)
        narrow = np.flatnonzero(high - low <= self.sigma)
        sizes = (high - low)[narrow]
        state = np.repeat(narrow, sizes)
        at = np.arange(len(state)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[narrow], sizes)
        c = self.before[at]
        state, c = state[c > 0], c[c > 0]
        pairs = np.unique(np.concatenate([state * (self.sigma + 1) + c, (wide[:, None] * (self.sigma + 1) + np.arange(1, self.sigma + 1)).ravel()]))
        return pairs // (self.sigma + 1), pairs % (self.sigma + 1)

    def near(self, patterns: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) for words one edit away whose edit lies behind the first ``exact`` characters."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(patterns).encode("utf-32-le"), np.int32)
        at = np.minimum(np.searchsorted(self.letters, codes), self.sigma - 1)
        text = np.append(np.where(self.letters[at] == codes, at + 1, -1), 0)
        p = np.arange(len(patterns))
        low, high = (np.full(len(p), x, np.int64) for x in self.every)
        for j in range(int(exact.max(initial=0))):
            going = np.flatnonzero((exact[p] > j) & (low < high))
            low[going], high[going] = self.step(text[starts[p[going]] + j], low[going], high[going])
        p, low, high = (x[low < high] for x in (p, low, high))
        j = exact[p]
        found: list[np.ndarray] = []
        while len(p):
            open_ = j < lengths[p]
            c = np.where(open_, text[np.minimum(starts[p] + j, len(text) - 1)], 0)
            state, letter = self.children(low, high)
            l2, h2 = self.step(letter, low[state], high[state])
            other = open_[state] & (letter != c[state])
            # One character of the pattern left out, replaced, or one put in before it.
            tried = (
                np.concatenate([p[open_], p[state[other]], p[state]]), np.concatenate([j[open_] + 1, j[state[other]] + 1, j[state]]),
                np.concatenate([low[open_], l2[other], l2]), np.concatenate([high[open_], h2[other], h2]),
            )
            found.append(self._finish(*tried, text, starts, lengths))
            p, j, low, high, c = (x[open_] for x in (p, j, low, high, c))
            low, high = self.step(c, low, high)
            p, j, low, high = (x[low < high] for x in (p, j + 1, low, high))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        n = len(self.word)
        return pairs // n, self.word[pairs % n]

    def _finish(self, p, j, low, high, text, starts, lengths) -> np.ndarray:
        """The rest of the patterns without error, up to the mark; pattern times words plus word."""
        done: list[np.ndarray] = []
        while len(p):
            end = j == lengths[p]
            c = np.where(end, 0, text[np.minimum(starts[p] + j, len(text) - 1)])
            low, high = self.step(c, low, high)
            ok = low < high
            # Words are distinct, so a word between two marks is one suffix.
            done.append(p[ok & end] * len(self.word) + low[ok & end])
            on = ok & ~end
            p, j, low, high = p[on], j[on] + 1, low[on], high[on]
        return np.concatenate(done) if done else np.zeros(0, np.int64)


def _sides(words: DataFrame) -> DataFrame:
    """Each word twice: as ``s`` read from the left (side 0) and from the right (side 1)."""
    return words.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("s", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n) for all pairs of ``words`` (word, n; distinct) one edit apart; a pair may come twice.

    A word of length l meets only patterns of l - 1, l and l + 1 characters that begin, or end,
    with the same (l - 1) / 2 characters, so words are dealt to indexes by these. A key with many
    words or patterns is dealt to several cells, each with a part of both.
    """
    words = words.withColumn("l", F.length("word"))
    key = lambda: F.xxhash64("side", "target", F.substring(F.col("s"), F.lit(1), ((F.col("target") - 1) / 2).cast("int")))
    held = _sides(words).withColumn("target", F.col("l")).select("word", "n", "s", "side", key().alias("key"))
    targets = F.explode(F.array(F.col("l") - 1, F.col("l"), F.col("l") + 1))
    asked = _sides(words).withColumn("target", targets).where(F.col("target") >= LEAST_LENGTH)
    exact = F.when(F.col("side") == 0, F.floor(F.col("l") / 2)).otherwise(F.ceil(F.col("l") / 2)).cast("int")
    asked = asked.select("word", "s", "side", exact.alias("exact"), key().alias("key"))
    part = shard_words // 4
    loads = held.select("key", F.lit(1).alias("h"), F.lit(0).alias("a")).union(asked.select("key", F.lit(0), F.lit(1)))
    loads = loads.groupBy("key").agg(F.sum("h").alias("h"), F.sum("a").alias("a")).where((F.col("h") > 0) & (F.col("a") > 0))
    total = words.count()
    shards = max(1, ceil(total / shard_words))
    heavy = cut(loads.where((F.col("h") > part) | (F.col("a") > 4 * part)).select(F.col("key").alias("k"), F.ceil(F.col("h") / part).cast("int").alias("hs"), F.ceil(F.col("a") / (4 * part)).cast("int").alias("as")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        met = rows.join(heavy, F.col("key") == F.col("k"), "left")
        mine = F.pmod(F.xxhash64("word"), F.coalesce(own, F.lit(1))).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        met = met.withColumn("x", mine).withColumn("y", all_others)
        cell = F.xxhash64("key", "x", "y") if own == "hs" else F.xxhash64("key", "y", "x")
        # Either side has its own indexes: a word may be another one read backwards.
        return met.withColumn("shard", F.pmod(cell, F.lit(shards)).cast("int") * 2 + F.col("side")).drop("k", "hs", "as", "x", "y", "key")

    left = dealt(held, "hs", "as").dropDuplicates(["shard", "s"])
    right = dealt(asked, "as", "hs").dropDuplicates(["shard", "s", "exact"]).select(F.col("shard").alias("place"), F.col("word").alias("asker"), F.col("s").alias("pattern"), "exact")

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [PAIRS.empty_table()]
        if mine.num_rows and theirs.num_rows:
            index = SuffixIndex(mine.column("s").to_pylist())
            names, counts = mine.column("word"), mine.column("n")
            for start in range(0, theirs.num_rows, PATTERNS):
                block = theirs.slice(start, PATTERNS)
                p, w = index.near(block.column("pattern").to_pylist(), block.column("exact").to_numpy().astype(np.int64))
                found.append(pa.table([block.column("asker").take(pa.array(p)), names.take(pa.array(w)), counts.take(pa.array(w))], schema=PAIRS))
        return pa.concat_tables(found)

    return left.groupBy("shard").cogroup(right.groupBy("place")).applyInArrow(meet, "word string, near string, near_n bigint")


def words_of(docs: DataFrame, *, slips: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts and how often they stand there; ``slips`` as in ``with_slips``.

    Runs are counted in each task before they are shuffled, so a word found everywhere is one row per task.
    """
    runs = docs.select("doc_id", F.explode(runs_of(F.col("text"))).alias("run"))
    word = F.col("run") if slips is None else with_slips(F.col("doc_id"), F.col("run"), slips)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def forms_of(words: DataFrame, *, factor: int = FACTOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n; distinct, of five characters or more).

    The form of a word is the most frequent word one edit away, ties to the smaller in
    code-point order, if it is ``factor`` times as frequent or more; its root is where the
    forms end. Each form has at least twice the count of the word, so chains are no longer
    than the logarithm of the largest count, and paths are halved that many times. A word has at most some
    hundred neighbours, whatever the vocabulary, so no group grows. No words give no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more: forms of equal counts would run in circles")
    words = cut(words.select("word", "n"))
    pairs = near_pairs(words, shard_words).distinct()
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    met = words.join(best, "word", "left")
    good = -F.col("b.less") >= factor * F.col("n")
    out = cut(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")))
    ways = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(ceil(log2(max(2.0, log2(most + 1))))):
        ways = cut(_joined(ways, ways).select("word", F.coalesce("further", "root").alias("root")))
    ends = ways.select(F.col("word").alias("_w"), F.col("root"))
    return out.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _joined(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """``rows`` with where their root leads to (``further``); a root of many words is dealt to salts."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    further = ways.select(F.col("word").alias("_w"), F.col("root").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_t"))
    return salted.join(further, (F.col("root") == F.col("_w")) & (F.col("_s") == F.col("_t")), "left")


def variants(docs: DataFrame, *, slips: int | None = None) -> DataFrame:
    """``forms_of`` the words of ``docs``.

    Texts that are NULL, empty or hold no letters give no words; repeated rows count each
    time; a run of any length is one word; columns other than doc_id and text are not looked at.
    """
    return forms_of(words_of(docs, slips=slips))
