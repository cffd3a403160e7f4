"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.llm.shingles import shingles
from tidemark.session import cut

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: MinHash values of a text, and how many of them make a band. At the threshold itself a pair
#: misses all 32 bands once in 20 million.
HASHES, BAND = 128, 4
BANDS = HASHES // BAND
#: A pair is dropped when the chance that it reaches the threshold falls below this.
TOLERANCE = 1e-7
#: Values compared between two looks at the odds.
LOOK = 16
#: Bits of the bitmap that spares texts without a partner a shuffle: 1 MB.
SIEVE_BITS = 1 << 23
#: Members of a bucket that are held against each other at once; larger buckets go in pairs of such pieces.
BLOCK = 512
#: Pairs whose MinHash values are compared at once, so that a full block takes few MB beside its rows.
PAIRS = 1 << 15

_random = np.random.default_rng(77)
_MULTIPLY = _random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_JOIN = _random.integers(0, 2**63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The HASHES least values of a set under as many seeded orders."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, ((x[at : at + 1024, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=least)
    return least


def bands(signature: np.ndarray) -> np.ndarray:
    """One 63-bit number per band and signature."""
    parts = signature.reshape(*signature.shape[:-1], BANDS, BAND).astype(np.uint64)
    mixed = ((parts + np.uint64(1)) * _JOIN).sum(axis=-1, dtype=np.uint64) ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values compared, the fewest matches with which a pair stays in.

    With a uniform prior the similarity given m of n matches is Beta(m + 1, n - m + 1), whose
    mass above the threshold is the chance of at most m successes in n + 1 trials at it.
    """
    out = {}
    for n in range(LOOK, HASHES + 1, LOOK):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def signatures(texts: DataFrame, size: int) -> DataFrame:
    """(tid, text) rows to (tid, sig, bands); texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sigs = [], []
            for i, hashes in enumerate(shingles(batch.column(1), size)):
                if len(hashes):
                    rows.append(i)
                    sigs.append(minhash(hashes))
            if not rows:
                continue
            table = np.stack(sigs)
            lists = pa.ListArray.from_arrays(np.arange(0, len(rows) * BANDS + 1, BANDS, dtype=np.int32), bands(table).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([s.tobytes() for s in table], pa.binary()), lists], names=["tid", "sig", "bands"]
            )

    return texts.select("tid", "text").mapInArrow(run, "tid string, sig binary, bands array<bigint>")


def sieve(tids: DataFrame) -> np.ndarray:
    """A bitmap of SIEVE_BITS bits with two set for each tid; its size does not depend on theirs.

    It only saves work: texts it lets through are joined exactly afterwards, and once it is
    full it lets all through.
    """
    spots = tids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "tid"), F.lit(SIEVE_BITS)) for k in (1, 2)])).alias("bit"))
    words = spots.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS INT))")).alias("bits"))
    out = np.zeros(SIEVE_BITS // 32, dtype=np.uint32)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return out


def shingle_sets(texts: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(tid, text) rows to (tid, grams), the sorted distinct shingle hashes as bytes, of the tids in ``wanted``.

    Texts that are not wanted are left out where they stand, by a bitmap, before any shuffle.
    """
    bits = texts.sparkSession.sparkContext.broadcast(sieve(wanted))
    marked = texts.select("tid", "text", *[F.pmod(F.xxhash64(F.lit(k), "tid"), F.lit(SIEVE_BITS)).alias(f"p{k}") for k in (1, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            spots = [batch.column(i).to_numpy() for i in (2, 3)]
            batch = batch.filter(pa.array(np.logical_and(*[(table[p >> 5] >> (p & 31).astype(np.uint32)) & 1 > 0 for p in spots])))
            grams = [np.unique(h).tobytes() for h in shingles(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["tid", "grams"])

    return marked.mapInArrow(run, "tid string, grams binary").join(wanted, "tid", "left_semi")


def likely_pairs(sigs: np.ndarray, side: np.ndarray, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block whose first common band is ``band`` and that the comparison of their MinHash values leaves in.

    ``side`` tells the two pieces of a bucket apart; when all are of one piece, every pair
    inside it is looked at, else every pair across.
    """
    a, b = np.nonzero(side[:, None] < side[None, :]) if side.any() and not side.all() else np.triu_indices(len(side), 1)
    keys = bands(sigs)
    for k in range(band):
        if not len(a):
            return a, b
        new = keys[a, k] != keys[b, k]
        a, b = a[new], b[new]
    same = keys[a, band] == keys[b, band]
    a, b = a[same], b[same]
    left = [likely(sigs, a[at : at + PAIRS], b[at : at + PAIRS], least) for at in range(0, len(a), PAIRS)]
    return (np.concatenate([x for x, _ in left]), np.concatenate([y for _, y in left])) if left else (a, b)


def likely(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that stay in at every look at the odds."""
    hits = np.zeros(len(a), dtype=np.int64)
    for n in range(LOOK, HASHES + 1, LOOK):
        hits += (sigs[a, n - LOOK : n] == sigs[b, n - LOOK : n]).sum(axis=1)
        stay = hits >= least[n]
        a, b, hits = a[stay], b[stay], hits[stay]
    return a, b


def linked_pairs(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs, sorted by ``a``, whose sets reach the threshold, by exact intersection."""
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[near], b[near]
    linked = np.zeros(len(a), dtype=bool)
    bounds = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
    for at, end in zip(bounds, [*bounds[1:], len(a)]):
        mine = sets[a[at]]
        for lo in range(at, end, 64):
            others = [sets[k] for k in b[lo : min(lo + 64, end)]]
            flat = np.concatenate(others)
            spots = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            lengths = np.array([len(o) for o in others])
            common = np.add.reduceat((mine[spots] == flat).astype(np.int64), np.append(0, np.cumsum(lengths)[:-1]))
            linked[lo : lo + len(others)] = common >= threshold * (len(mine) + lengths - common) - 1e-9
    return a[linked], b[linked]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block after the other; the batches are sorted by the column ``block``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi == lo:
                continue
            if held and held[-1].column(0)[0] != batch.column(0)[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def pruned(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Of rows (block, band, side, tid, sig), sorted by block, those with a likely partner in their block, without sig."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            if table.num_rows < 2:
                continue
            sigs = np.stack([np.frombuffer(s, dtype=np.uint32) for s in table.column("sig").to_pylist()])
            a, b = likely_pairs(sigs, table.column("side").to_numpy(), table.column("band")[0].as_py(), least)
            if len(a):
                yield from table.drop_columns("sig").take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()

    return blocks.mapInArrow(run, "block bigint, band int, side int, tid string")


def verified(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Rows (block, band, side, tid, copies, sig, grams), sorted by block, to (tid, links, root).

    ``links`` counts the documents that the text is linked to by pairs of this block, ``root``
    is the least text it hangs together with there. No pair leaves the task.
    """
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            if table.num_rows < 2:
                continue
            tids, copies = table.column("tid").to_pylist(), table.column("copies").to_numpy()
            sigs = np.stack([np.frombuffer(s, dtype=np.uint32) for s in table.column("sig").to_pylist()])
            sets = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
            a, b = likely_pairs(sigs, table.column("side").to_numpy(), table.column("band")[0].as_py(), least)
            a, b = linked_pairs(a, b, sets, threshold)
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(tids)) + np.bincount(b, copies[a], len(tids))
            order = np.argsort(np.array(tids))
            rank = np.empty(len(tids), dtype=np.int64)
            rank[order] = np.arange(len(tids))
            root = rank.copy()
            while True:  # the least rank spreads along the links, halving its way through roots
                before = root.copy()
                np.minimum.at(root, a, before[b])
                np.minimum.at(root, b, before[a])
                root = root[order[root]]
                if (root == before).all():
                    break
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tids[i] for i in hit]), pa.array(links[hit].astype(np.int64)), pa.array([tids[order[root[i]]] for i in hit])], names=["tid", "links", "root"]
            )

    return blocks.mapInArrow(run, "tid string, links bigint, root string")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def links(docs: DataFrame, *, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Of the distinct texts of ``docs``: (tid, copies, links) and the star edges (a, b) of linked texts.

    Exact copies are one text with a count. A text goes into 32 buckets by bands of its
    MinHash; a pair is looked at in the bucket of its first common band only. Buckets with
    the same members are looked at once. A large bucket is dealt in pieces and goes through
    the workers as pairs of pieces, each of bounded size: with MinHash values alone first, then
    with the shingles of the texts that still have a likely partner.
    """
    texts = docs.select(text_key(F.col("text")).alias("tid"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sigs = signatures(texts, size)
    sigs = cut(sigs.groupBy("tid").agg(F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    spread = sigs.select("tid", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("tid")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "tid")).alias("m2")
    )
    once = shared.where("n > 1").groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("n", "b.band", "b.bucket")
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    members = spread.drop("band").join(once, "bucket").withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("tid"), F.col("pieces")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    block = F.xxhash64("bucket", F.least("piece", "other"), F.greatest("piece", "other"))
    dealt = dealt.select(block.alias("block"), "band", (F.col("piece") > F.col("other")).cast("int").alias("side"), "tid")
    likely = dealt.join(sigs.select("tid", "sig"), "tid").select("block", "band", "side", "tid", "sig")
    likely = cut(pruned(likely.repartition("block").sortWithinPartitions("block"), threshold, tolerance))
    grams = shingle_sets(texts, size, likely.select("tid").distinct()).groupBy("tid").agg(F.first("grams").alias("grams"))
    facts = sigs.select("tid", "copies", "sig").join(grams, "tid")
    whole = likely.join(facts, "tid").select("block", "band", "side", "tid", "copies", "sig", "grams")
    dealt = whole.repartition("block").sortWithinPartitions("block")
    found = cut(verified(dealt, threshold, tolerance))
    counted = found.groupBy("tid").agg(F.sum("links").alias("links"))
    return sigs.select("tid", "copies").join(counted, "tid", "left"), found.select(F.col("tid").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, *, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, tid, class_id and n_links.

    ``n_links`` counts the other documents whose sets of ``size``-word shingles have Jaccard
    similarity ``threshold`` or more, copies included; ``class_id`` is the least doc_id (NULL
    last) among the documents that hang together by links. A text of fewer words is one
    shingle; texts without words (NULL, empty, blank) are linked to nothing and are their
    own class.
    """
    counted, edges = links(docs, size=size, threshold=threshold, tolerance=tolerance)
    roots = components(edges).withColumnRenamed("node", "tid")
    texts = cut(counted.join(roots, "tid", "left").select("tid", "copies", "links", F.coalesce("root", "tid").alias("root")))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tid")).join(texts, "tid", "left")
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = rows.join(least, "root", "left")
    own = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("doc_id", "tid", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), own.cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, *, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one document stays.

    It is the one with the least doc_id (NULL last), then the least text hash; of rows alike in
    both, one. Documents without words all stay.
    """
    counted, edges = links(docs, size=size, threshold=threshold, tolerance=tolerance)
    roots = components(edges).withColumnRenamed("node", "tid")
    texts = cut(counted.join(roots, "tid", "left").select("tid", F.coalesce("root", "tid").alias("root")))
    names = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_key(F.col("text")).alias("_tid"), F.monotonically_increasing_id().alias("_n"))
    marked = cut(marked)
    rows = marked.select(F.col("row.doc_id").alias("doc_id"), F.col("_tid").alias("tid"), F.col("_n").alias("n")).join(texts, "tid")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tid", "n")
    # Documents that go: all but the least of their class.
    best = rows.groupBy("root").agg(F.min(rank).alias("best"))
    gone = rows.join(best, "root").where(F.col("n") != F.col("best.n")).select(F.col("n").alias("_gone"))
    return marked.join(gone, F.col("_n") == F.col("_gone"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in names])

