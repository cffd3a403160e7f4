"""Line dedup by a log-template tree.

The tree has a level for the number of tokens and one for each leading token; fields with a
digit are variable from the start. In a leaf, a token is a constant of its place when enough
documents have it there; the other fields are generalised, and lines of the same constants
are one template. A line of some words that stands word by word in two documents recurs by
itself, whatever its leaf. Very short lines, such as a brace or a "Yes", have no meaning by
themselves and never recur. Which fields vary depends on counts over all documents, never on the
order in which lines come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import identity, salted_join
from tidemark.session import cut

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Documents in which a generalised template must stand to be recurring, and a token to be a constant.
LEAST_DOCS = 10
#: Share of a template's plain words that must be constants; fields with a digit do not count.
CONSTANT = 0.7
FIELD = "<*>"
#: Tokens a line needs to have a template, and to recur as it stands.
LEAST_TOKENS, LEAST_VERBATIM = 3, 4


def plain_line(line: Column) -> Column:
    """A line with one space between its tokens; blank lines are empty."""
    return F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "), F.lit(" "))


def shape_of(plain: Column) -> Column:
    """A plain line with its tokens with digits generalised."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def shape(line: Column) -> Column:
    return shape_of(plain_line(line))


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, key and per line in order the hash h of its shape, its leaf and the hash v of the line itself; NULL for lines too short for either."""
    base = docs.select("doc_id", identity(F.col("doc_id"), F.col("text")).alias("key"), F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), plain_line).alias("plain"))
    base = base.withColumn("shapes", F.transform("plain", shape_of))

    def place(x: Column, i: Column) -> Column:
        # The leading tokens, as text: an index into the line is cheaper than its whole split.
        n = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
        own = F.when(n + 1 >= LEAST_VERBATIM, F.xxhash64(F.get("plain", i)))
        return F.when(n + 1 >= LEAST_TOKENS, F.struct(F.xxhash64(x).alias("h"), F.xxhash64(n, F.substring_index(x, " ", depth)).alias("leaf"), own.alias("v")))

    return base.select("doc_id", "key", F.transform("shapes", place).alias("lines"))


def line_templates(docs: DataFrame, table: DataFrame, depth: int, least_docs: int, constant: float) -> DataFrame:
    """(h, template) for every line whose template is general enough; ``table`` is ``lines_of(docs)`` as written.

    Only lines of leaves found in ``least_docs`` documents can recur, so only those are ever
    taken apart. Each distinct line is taken apart once, with the number of documents it
    stands for, however many those are. A line of fields with digits alone has no template.
    """
    seen = table.select("key", F.explode(F.array_distinct("lines")).alias("x")).where("x IS NOT NULL").select("key", "x.h", "x.leaf").distinct()
    per_line = seen.groupBy("leaf", "h").agg(F.count("*").alias("docs"))
    leaves = per_line.groupBy("leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("leaf")
    wanted = cut(salted_join(per_line, leaves, "leaf", "h"))
    # One place where each wanted line stands; its text is fetched from there.
    at = table.select("key", F.posexplode("lines").alias("at", "x")).where("x IS NOT NULL").select("key", "at", "x.h")
    spots = at.join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.min(F.struct("key", "at")).alias("s"))
    per_doc = spots.groupBy("s.key").agg(F.collect_list(F.struct("h", F.col("s.at").alias("at"))).alias("spots")).withColumnRenamed("key", "_key")
    text = docs.select(identity(F.col("doc_id"), F.col("text")).alias("key"), "text")
    cutup = text.join(per_doc, F.col("key") == F.col("_key")).select("spots", F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("l"))
    found = cutup.select(F.explode(F.transform("spots", lambda s: F.struct(s["h"].alias("h"), shape(F.get("l", s["at"])).alias("shape")))).alias("x"))
    found = found.select("x.h", "x.shape").dropDuplicates(["h"])
    fields = cut(wanted.join(found, "h").select("h", "leaf", "docs", F.posexplode(F.split("shape", " ")).alias("p", "token")))
    common = fields.where(F.col("p") >= depth).groupBy("leaf", "p", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs).drop("n")
    # A leaf may hold most lines: its constants are repeated per salt, its lines dealt to the salts.
    known = common.select("leaf", "p", "token", F.lit(True).alias("common"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    marked = fields.withColumn("salt", F.pmod("h", F.lit(16)).cast("int")).join(known, ["leaf", "p", "token", "salt"], "left")
    fixed = (F.col("token") != FIELD) & ((F.col("p") < depth) | F.coalesce("common", F.lit(False)))
    marked = marked.select("h", "p", fixed.alias("fixed"), (F.col("token") == FIELD).alias("digits"), F.when(fixed, F.col("token")).otherwise(FIELD).alias("field"))
    whole = marked.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("p", "field"))).alias("f"), F.avg(F.when(~F.col("digits"), F.col("fixed").cast("int"))).alias("share"))
    return whole.where(F.col("share") >= constant).select("h", F.array_join(F.transform("f", lambda x: x["field"]), " ").alias("template"))


def verbatim(table: DataFrame) -> DataFrame:
    """(h, template) of the lines that stand word by word in two documents; the template is a line break and the hash."""
    own = table.select(F.xxhash64("key").alias("own"), F.explode(F.array_distinct("lines.v")).alias("h")).where("h IS NOT NULL")
    met = own.groupBy("h").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high")
    return met.select("h", F.concat(F.lit("\n"), F.col("h").cast("string")).alias("template"))


def recurring(docs: DataFrame, *, depth: int = DEPTH, least_docs: int = LEAST_DOCS, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """(template, docs, first) of the recurring templates, and (key, out) the line numbers that go.

    A template recurs when lines of it stand in ``least_docs`` documents, a line as it stands
    when two documents have it; such lines have no row in the first table. The first of the
    documents (least doc_id, NULL last, then key) keeps its lines.
    """
    table = cut(lines_of(docs, depth))
    lines = cut(line_templates(docs, table, depth, least_docs, constant).union(verbatim(table)))
    at = table.select("doc_id", "key", F.posexplode("lines").alias("at", "x")).where("x IS NOT NULL")
    at = at.select("doc_id", "key", "at", F.explode(F.array_distinct(F.array("x.h", "x.v"))).alias("h"))
    standing = cut(salted_join(at, lines, "h", "key").drop("h"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    in_docs = standing.groupBy("template", "doc_id", "key").agg(F.lit(1).alias("one"))
    found = in_docs.groupBy("template").agg(F.count("*").alias("docs"), F.min(order).alias("first"))
    same = F.col("template").startswith("\n")
    found = found.where(same | (F.col("docs") >= least_docs))
    found = found.select("template", "docs", F.col("first.key").alias("first"))
    gone = salted_join(standing, found, "template", "key").where(F.col("key") != F.col("first")).groupBy("key").agg(F.collect_set("at").alias("out"))
    return found.where(~same), gone


def dedup(docs: DataFrame, *, depth: int = DEPTH, least_docs: int = LEAST_DOCS, constant: float = CONSTANT) -> DataFrame:
    """The rows of ``docs`` as ``row``, with n_lines, n_dropped and ``made``, the text without recurring lines.

    Lines of a template that recurs across documents, and lines that recur as they stand, are
    dropped everywhere but in the first document that has them. Lines of fewer than
    ``LEAST_TOKENS`` tokens stay, blank ones too. Rows with equal doc_id and
    text are one document; NULL and empty texts stay as they are. A document may end up
    empty; it is still a row. Lines that recur only inside one document stay.
    """
    _, gone = recurring(docs, depth=depth, least_docs=least_docs, constant=constant)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), identity(F.col("doc_id"), F.col("text")).alias("_key"))
    met = base.join(gone, F.col("_key") == F.col("key"), "left").withColumn("l", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("out"))
    met = met.withColumn("left", F.when(F.col("out").isNotNull(), left))
    made = F.when(F.col("out").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("l", i)), "\n"))
    return met.select("row", F.size("l").cast("bigint").alias("n_lines"), F.coalesce(F.size("out"), F.lit(0)).cast("bigint").alias("n_dropped"), made.alias("made"))


def keep(docs: DataFrame, *, depth: int = DEPTH, least_docs: int = LEAST_DOCS, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with the texts that ``dedup`` leaves; documents that lost their last word go."""
    out = dedup(docs, depth=depth, least_docs=least_docs, constant=constant)
    bare = (F.col("n_dropped") > 0) & ~F.col("made").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(bare, F.lit(False))).select(*[F.col("made").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
