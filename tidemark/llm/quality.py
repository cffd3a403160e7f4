"""Quality rules: base statistics of a text, then robust outliers per language and source.

Every step is a DataFrame or SQL expression. Statistics are turned into whole numbers before
anything is summed, so sums are exact and a rerun gives the same verdicts whatever the
order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, identity, words
from tidemark.session import cut

#: Words of a window that counts as repeated when it is found twice in a text.
WINDOW = 8
#: Groups with fewer documents are judged together.
LEAST_ROWS = 50
#: Share of a group's documents that the estimate is taken from.
CORE = 0.75
#: Makes the covariance of the core right for normal data: CORE / P(chi2(7) <= q), q the CORE quantile of chi2(5).
CONSISTENCY = 1.41207
#: Squared distance beyond which a document is rejected: the 99.9 % point of chi2(5).
CUTOFF = 20.515
#: Concentration steps after the start from medians and quartiles.
STEPS = 6
#: Least standard deviations, in thousandths, of: log mean word length, roots of the shares
#: of symbols, repeated lines and repeated words, log of the number of words.
FLOORS = (60, 60, 150, 150, 700)
P = len(FLOORS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, key and the base statistics of each row; NULL text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", identity(F.col("doc_id"), F.col("text")).alias("key"), text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    base = base.select(
        "doc_id", "lang", "source", "key", "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    base = base.withColumns({"h": hashes, "n_lines": F.size("lines").cast("bigint"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")})
    spot = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    base = base.drop("w", "lines").withColumn("g", F.when(F.size("h") >= WINDOW, spot).otherwise(F.array().cast("array<bigint>"))).drop("h")
    # Only texts that hold a window twice are sorted: equal windows then stand side by side.
    twice = F.size(F.array_distinct("g")) < F.size("g")
    base = base.withColumn("s", F.when(twice, F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("g")
    alike = lambda e, k: F.coalesce(F.get("s", k)["x"] == e["x"], F.lit(False))
    marked = F.transform("s", lambda e, k: F.when(alike(e, k - 1) | alike(e, k + 1), e["i"]))
    base = base.withColumn("at", F.array_sort(F.filter(marked, lambda x: x.isNotNull()))).drop("s")
    steps = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")
    return base.withColumn("n_repeat_words", covered).drop("at")


def features(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and the statistics as whole numbers x1 to x5, roots and logs in thousandths.

    The mean word length and the shares are held back for short texts by a few added words.
    """
    whole = lambda c: F.floor(c * 1000 + 0.5).cast("bigint")
    n = F.col("n_words")
    return stats.withColumns({
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "x1": whole(F.log((F.col("word_chars") + 250) / (n + 50))),
        "x2": whole(F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 100))),
        "x3": whole(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4))),
        "x4": whole(F.sqrt(F.col("n_repeat_words") / (n + 50))),
        "x5": whole(F.log(n + 1.0)),
        "own": F.concat_ws("/", *[F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))) for c in ("lang", "source")]),
    })


def grouping_sql(rows: str) -> str:
    """The rows the estimates come from, each with its group; small groups are one group, ``*``."""
    return f"""
SELECT r.*, CASE WHEN c.n >= {LEAST_ROWS} THEN r.own ELSE '*' END AS grp
FROM {rows} r JOIN (SELECT own, count(*) AS n FROM {rows} WHERE NOT base_failed GROUP BY own) c ON r.own = c.own
WHERE NOT r.base_failed"""


def start_sql(rows: str) -> str:
    """First estimate: medians and quartiles of each statistic, from exact counts of its values."""
    stacked = " UNION ALL ".join(f"SELECT grp, {i} AS f, x{i} AS v FROM {rows}" for i in range(1, P + 1))
    point = lambda q: f"min(CASE WHEN upto >= {q} * total THEN v END)"
    floors = " ".join(f"WHEN f = {i + 1} THEN {x}" for i, x in enumerate(FLOORS))
    cols = [f"max(CASE WHEN f = {i} THEN med END) AS m{i}" for i in range(1, P + 1)]
    cols += [f"max(CASE WHEN f = {i} THEN scale END) AS l{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS l{i}{j}" for i in range(1, P + 1) for j in range(1, i + 1)]
    return f"""
SELECT grp, {', '.join(cols)}
FROM (SELECT grp, f, CAST(med AS DOUBLE) AS med, greatest(CAST(CASE {floors} END AS DOUBLE), 0.7413 * (q3 - q1)) AS scale
      FROM (SELECT grp, f, {point(0.5)} AS med, {point(0.25)} AS q1, {point(0.75)} AS q3
            FROM (SELECT grp, f, v, sum(c) OVER (PARTITION BY grp, f ORDER BY v) AS upto, sum(c) OVER (PARTITION BY grp, f) AS total
                  FROM (SELECT grp, f, v, count(*) AS c FROM ({stacked}) a GROUP BY grp, f, v) b) d
            GROUP BY grp, f) e) g
GROUP BY grp"""


def distance_sql(rows: str, params: str) -> str:
    """``rows`` with d2, the squared Mahalanobis distance from their group's estimate."""
    text = f"SELECT r.*, {', '.join(f'p.m{i}' for i in range(1, P + 1))}, {', '.join(f'p.l{i}{j}' for i in range(1, P + 1) for j in range(1, i + 1))} FROM {rows} r JOIN {params} p ON r.grp = p.grp"
    for i in range(1, P + 1):
        rest = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        text = f"SELECT *, (x{i} - m{i}{rest}) / l{i}{i} AS y{i} FROM ({text}) t{i}"
    return f"SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(1, P + 1))} AS d2 FROM ({text}) t"


def step_sql(rows: str, params: str) -> str:
    """One concentration step: the nearest CORE of each group gives the next estimate.

    Distances are binned finely on a log scale and moments summed per bin, so that a group of
    any size comes down to a bounded number of rows in one shuffle; the bin that completes
    the core is taken whole.
    """
    pairs = [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]
    sums = [f"s{i}" for i in range(1, P + 1)] + [f"s{i}{j}" for i, j in pairs]
    terms = [f"sum(x{i}) AS s{i}" for i in range(1, P + 1)] + [f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in pairs]
    cells = f"SELECT grp, bin, count(*) AS c, {', '.join(terms)} FROM (SELECT *, CAST(floor(ln(1 + d2) * 48) AS BIGINT) AS bin FROM ({distance_sql(rows, params)}) a) b GROUP BY grp, bin"
    ranked = f"SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY bin) - c AS ahead, sum(c) OVER (PARTITION BY grp) AS total FROM ({cells}) d"
    core = f"SELECT grp, CAST(sum(c) AS DOUBLE) AS n, {', '.join(f'CAST(sum({s}) AS DOUBLE) AS {s}' for s in sums)} FROM ({ranked}) e WHERE ahead < {CORE} * total GROUP BY grp"
    text = f"SELECT *, {', '.join(f's{i} / n AS m{i}' for i in range(1, P + 1))} FROM ({core}) g"
    floor = lambda i, j: f" + {FLOORS[i - 1] ** 2}" if i == j else ""
    text = f"SELECT *, {', '.join(f'{CONSISTENCY} * (s{i}{j} / n - m{i} * m{j}){floor(i, j)} AS v{i}{j}' for i, j in pairs)} FROM ({text}) h"
    for i, j in pairs:  # Cholesky, row by row
        done = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        rest = f"v{i}{j}{done}"
        text = f"SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l{j}{j}'} AS l{i}{j} FROM ({text}) k{i}{j}"
    return f"SELECT grp, {', '.join(f'm{i}' for i in range(1, P + 1))}, {', '.join(f'l{i}{j}' for i, j in pairs)} FROM ({text}) z"


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, base statistics, base_failed, distance, kept.

    ``kept`` is false for texts that fail the base rules. The others are held against the
    minimum-covariance-determinant estimate of their language and source (NULL is a value of
    its own): start from medians, then concentration steps on the nearest three quarters.
    Groups of fewer than ``LEAST_ROWS`` documents share one estimate. Variances have a floor,
    so statistics that are nearly constant reject nobody. An empty table has no verdicts;
    copies count as often as they occur.
    """
    spark = docs.sparkSession
    rows = cut(features(statistics(docs)).withColumn("row", F.monotonically_increasing_id()))
    kept_cols = ", ".join(f"x{i}" for i in range(1, P + 1))
    numbers = cut(spark.sql(f"SELECT row, grp, {kept_cols} FROM ({grouping_sql('{rows}')}) q", rows=rows))
    params = cut(spark.sql(start_sql("{numbers}"), numbers=numbers))
    for _ in range(STEPS):
        params = cut(spark.sql(step_sql("{numbers}", "{params}"), numbers=numbers, params=params))
    far = spark.sql(f"SELECT row, d2 FROM ({distance_sql('{numbers}', '{params}')}) q", numbers=numbers, params=params)
    out = rows.join(far, "row", "left")
    return out.select(
        "doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.col("d2") <= CUTOFF, F.lit(False)).alias("kept"), F.col("d2").alias("distance"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    names = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    out = verdicts(docs).where(~F.col("kept")).select(F.col("key").alias("_key")).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = marked.withColumn("_key", identity(F.col("row.doc_id"), F.col("row.text")))
    return marked.join(out, "_key", "left_anti").select(*names)

