"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE
from tidemark.session import cut

#: Marks that end a sentence, of several scripts. Commas count too: a passage that was cut out
#: in mid-sentence still holds whole clauses.
MARKS = ".!?;:,\\n。．！？；：，、…؟،؛।॥։።"
SENTENCE = f"[^{MARKS}]+[{MARKS}]*|[{MARKS}]+"
#: Sentences in the longest run, and the bytes (UTF-8) a run of one, two, ... sentences needs:
#: shorter ones are no passages, a few stock words may meet anywhere. One sentence alone needs some 20 words.
RUN = 3
LEAST_BYTES = (120, 100, 60)
#: Runs with more than one in so many of all places are hot: at most so many hashes.
HOT = 2048


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n (sentences), and hash w and bytes l of each sentence."""
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    cutup = text.select("doc_id", F.xxhash64("t").alias("mark"), sentences(F.col("t")).alias("s"))
    words = F.transform("s", lambda x: F.xxhash64(F.btrim(x, F.lit(WHITE))))
    return cutup.select("doc_id", "mark", F.size("s").alias("n"), words.alias("w"), F.transform("s", lambda x: F.octet_length(x)).alias("l"))


def spans(table: DataFrame, least_bytes: tuple[int, ...] = LEAST_BYTES) -> DataFrame:
    """(doc_id, mark, at, k, h) for each run of k sentences from sentence ``at`` on, with its hash.

    ``table`` is ``hashed``. Runs have one to ``len(least_bytes)`` sentences and the bytes
    asked for so many, or are the whole text and have the least of these. Each sentence is one
    row with the next ones beside it, so that runs are made by plain columns.
    """
    most = len(least_bytes)
    ahead = [F.slice(c, j + 1, F.greatest(F.col("n"), F.lit(1))).alias(f"{c}{j}") for c in ("w", "l") for j in range(most)]
    rows = table.where("n > 0").select("doc_id", "mark", "n", F.arrays_zip(*ahead).alias("z")).select("doc_id", "mark", "n", F.posexplode("z").alias("at", "z"))
    rows = rows.select("doc_id", "mark", "n", "at", *[F.col(f"z.{c}{j}").alias(f"{c}{j}") for c in ("w", "l") for j in range(most)])
    made = []
    for k in range(1, most + 1):
        size = sum((F.col(f"l{j}") for j in range(1, k)), F.col("l0"))
        # Of the whole text, the least number of bytes is asked.
        fits = (F.col("at") + k <= F.col("n")) & ((size >= least_bytes[k - 1]) | ((F.col("n") == k) & (size >= min(least_bytes))))
        made.append(F.when(fits, F.struct(F.lit(k).alias("k"), F.xxhash64(*[f"w{j}" for j in range(k)]).alias("h"))))
    return rows.select("doc_id", "mark", "at", F.explode(F.array(*made)).alias("x")).where("x IS NOT NULL").select("doc_id", "mark", "at", "x.k", "x.h")


def repeated(docs: DataFrame, *, least_bytes: tuple[int, ...] = LEAST_BYTES) -> DataFrame:
    """doc_id, mark, n and spots (at, k), where non-first repeats stand (NULL if nowhere), one row per document.

    Occurrences are ordered by doc_id (NULL last), text hash and place. Counting comes first and
    is combined before the shuffle, so that a run found in every document is one row per task;
    only runs found twice are then looked at with their places. The few runs with a large
    share of all places, at most ``HOT`` by their definition, are broadcast instead of shuffled to one task.
    """
    table = cut(hashed(docs))
    counted = cut(spans(table, least_bytes).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    bar = (counted.agg(F.sum("c")).first()[0] or 0) // HOT
    hot, rest = counted.where(F.col("c") > bar).select("h"), counted.where(F.col("c") <= bar).select("h")
    places = spans(table, least_bytes).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "h", "left")
    often = places.where("hot").distinct()
    again = cut(often.unionByName(places.where("hot IS NULL").join(rest, "h", "left_semi").distinct()))
    own = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark", "at")
    first = again.groupBy("h", "hot").agg(F.min(own).alias("first")).select("h", "first", F.col("hot").alias("hot_"))
    met = again.where("hot").join(F.broadcast(first.where("hot_")), "h").unionByName(again.where("hot IS NULL").join(first.where("hot_ IS NULL"), "h"))
    later = met.where(~own.eqNullSafe(F.col("first"))).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "k")).alias("spots"))
    marks = later.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spots")
    known = table.groupBy("doc_id", "mark").agg(F.max("n").alias("n"))
    return known.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "mark", "n", "spots")


def dedup(docs: DataFrame, *, least_bytes: tuple[int, ...] = LEAST_BYTES) -> DataFrame:
    """The rows of ``docs`` as column ``row``, with n_sentences, n_removed and ``made``, the text without repeats.

    Runs of whole sentences (see ``spans``) are hashed and met with the runs of all
    documents; sentences covered by a run that is not the first of its kind go. What is left
    is joined as it stood. NULL and empty texts stay; rows with equal doc_id and text are one
    document, so neither repeats the other; a document whose sentences all go has an empty
    text. No rows give no rows. Runs are compared by 64-bit
    hashes: in 10^13 runs, one in two million meets a foreign one.
    """
    marks = repeated(docs, least_bytes=least_bytes).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_own"))
    met = base.join(marks, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left")
    out = F.array_distinct(F.flatten(F.transform("spots", lambda x: F.sequence(x["at"], x["at"] + x["k"] - 1))))
    met = met.withColumn("out", F.when(F.col("spots").isNotNull(), out))
    met = met.withColumn("s", F.when(F.col("spots").isNotNull(), sentences(F.coalesce(F.col("row.text"), F.lit("")))))
    left = F.array_except(F.sequence(F.lit(0), F.size("s") - 1), F.col("out"))
    made = F.when(F.col("out").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("s", i)), ""))
    n_removed = F.when(F.col("out").isNotNull(), F.size("out")).otherwise(0)
    return met.select("row", F.col("n").cast("bigint").alias("n_sentences"), n_removed.cast("bigint").alias("n_removed"), made.alias("made"))
