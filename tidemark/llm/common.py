"""Shared pieces of the training-data operators: words, row identity, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: The characters between words: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a class of a regular expression, and its complement.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL, empty or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def identity(doc_id: Column, text: Column) -> Column:
    """Which document a row is: rows with equal id and equal text are one document.

    Ids may be NULL or repeat, so an id alone does not name a document. The value is a
    128-bit hex text, usable as a join key and for ordering without meaning.
    """
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.isnull(text).cast("string"), body))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected graph: one row (node, root) per linked node.

    ``root`` is the smallest node of the component. Alternates the two star steps: every
    node first hangs its larger neighbours, then its smaller ones, on the smallest node it
    sees. Each round is two aggregates and two joins over the links that are left, written to
    the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        # The links are a star forest, and stay as they are, once their hash is unchanged.
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def salted_join(rows: DataFrame, few: DataFrame, on: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Inner join of ``rows`` with ``few``, which has one row per value of ``on``.

    A value that a third of all rows carry would be one task's work, so each row of ``few``
    is repeated per salt and the rows are dealt to the salts by the hash of ``spread_by``.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [on, "_salt"]).drop("_salt")
