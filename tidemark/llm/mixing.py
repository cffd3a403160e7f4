"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count
from tidemark.session import cut

#: Hash digits that make a bucket: a source's documents are summed in 16**3 pieces.
BUCKET_DIGITS = 3
#: Pieces a source is dealt in when its documents meet its one row of the plan.
SALTS = 64


def ticket(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's fixed place in the seeded draw: hex digits spread evenly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Target of each source: ``sizes`` has one row (source, source_size) per source.

    The level is found in closed form. Sources are ranked by the level at which they reach
    their cap (cap / weight); taking all earlier ones as full, what is left is spread over
    the weights that are left. The first source that does not fill at that level fixes it.
    The windows run over one row per source.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(after))
    fixed = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    target = F.coalesce(F.least(F.col("weight") * fixed, F.col("cap")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(sized: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """How each source is drawn: ``sized`` has rows (source, ticket, size), one per document.

    Returns source, source_size, target, whole (repetitions every document gets) and
    cutoff (documents with a smaller ticket get one more; NULL for all of them).
    Documents are taken in ticket order while their middle lies within the words still
    wanted, so a source misses its target by at most half a document. Sums run over
    buckets of tickets first, then inside one bucket, so no source is sorted in one task.
    """
    units = sized.groupBy("source", "ticket").agg(F.sum("size").alias("size")).withColumn("bucket", F.substring("ticket", 1, BUCKET_DIGITS))
    pieces = cut(units.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    per_source = targets(pieces.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    size = F.col("source_size").cast("double")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("bigint")
    plan = cut(per_source.withColumn("whole", whole).withColumn("wanted", F.col("target") - F.col("whole") * size))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    same = starts.join(plan.select(F.col("source").alias("s"), "wanted"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Only the bucket where the wanted words run out has to be looked into.
    edge = same.where("start <= wanted AND start + bucket_size > wanted").select(F.col("source").alias("s"), F.col("bucket").alias("k"), "start", "wanted")
    inside = Window.partitionBy("source", "bucket").orderBy("ticket").rowsBetween(Window.unboundedPreceding, -1)
    looked = units.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    looked = looked.withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    over = looked.where(F.col("ahead") + F.col("size") / 2 > F.col("wanted")).groupBy("source").agg(F.min("ticket").alias("first_out"))
    # When the whole bucket fits, the cut lies at the start of the next one: its prefix is a bound.
    after = edge.select(F.col("s").alias("source"), F.concat(F.col("k"), F.lit("g")).alias("bucket_end"))
    outs = over.select(F.col("source").alias("o"), "first_out")
    ends = after.select(F.col("source").alias("e"), "bucket_end")
    joined = plan.join(outs, F.col("source").eqNullSafe(F.col("o")), "left").join(ends, F.col("source").eqNullSafe(F.col("e")), "left")
    return joined.select("source", "source_size", "target", "whole", F.coalesce("first_out", "bucket_end").alias("cutoff"))


def meet(rows: DataFrame, source: Column, ticket: Column, drawn: DataFrame) -> DataFrame:
    """``rows`` with the plan of their source, the plan repeated so that no source is one join key."""
    salted = drawn.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(ticket), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.col("_salt") == F.col("salt")) & source.eqNullSafe(F.col("s")))


def plan_mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17, sizes: bool = True) -> DataFrame:
    """Per document, how often the mix takes it: doc_id, source, size, source_size, target, repeats, taken.

    Sources in code point order (NULL last, a source of its own) weigh ``weights``, repeating.
    They share ``share`` times all words; no source goes beyond ``epochs`` times its words,
    and what it cannot take goes to the others by weight. NULL and empty texts have size 0:
    they are kept, and take nothing. Rows that are alike are drawn together. An empty table
    gives an empty plan. Other columns of ``docs`` are not read.
    """
    sized = cut(
        docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), ticket(F.col("doc_id"), F.col("text"), seed).alias("ticket"))
    )
    repeats = F.col("whole") + F.coalesce((F.col("ticket") < F.col("cutoff")), F.lit(False)).cast("bigint")
    out = meet(sized, F.col("source"), F.col("ticket"), draw(sized, weights, share, epochs)).withColumn("repeats", repeats)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed rows themselves: every document as often as ``plan_mix`` takes it.

    Documents whose repeats are 0 are left out; documents without words stay once, as they
    weigh nothing. The columns are those of ``docs``. Only (source, ticket, size) is shuffled:
    the texts stay where they are and meet one row per source.
    """
    names = docs.columns
    mark = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    mark = mark.withColumn("_ticket", ticket(F.col("row.doc_id"), F.col("row.text"), seed)).withColumn("_size", word_count(F.col("row.text")))
    sized = cut(mark.select(F.col("row.source").alias("source"), F.col("_ticket").alias("ticket"), F.col("_size").alias("size")))
    drawn = draw(sized, weights, share, epochs).select("source", "whole", "cutoff")
    repeats = F.col("whole") + F.coalesce((F.col("_ticket") < F.col("cutoff")), F.lit(False)).cast("bigint")
    met = meet(mark, F.col("row.source"), F.col("_ticket"), drawn)
    times = F.when(F.col("_size") == 0, F.lit(1).cast("bigint")).otherwise(repeats)
    return met.select("row", F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("_again")).select("row.*")
