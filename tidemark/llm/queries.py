"""The training-data operators as registered queries, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import impact, jaccard, manifest, mixing, permutation, pseudonyms, quality, secret_scan, sentence_spans, spelling, templates, toxicity, trie_bpe, twins

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


OP6_SQL = r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')) AS ticket
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, place, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place % 3) + 1] AS weight, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes)),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
goals AS (
  SELECT source, source_size, coalesce(least(weight * max(CASE WHEN cap / weight >= level THEN level END) OVER (), cap), cap) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS whole FROM goals),
units AS (SELECT source, ticket, sum(size) AS size FROM sized GROUP BY source, ticket),
ahead AS (
  SELECT u.source, u.ticket, u.size, coalesce(sum(u.size) OVER (PARTITION BY u.source ORDER BY u.ticket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM units u),
picked AS (
  SELECT a.source, a.ticket, p.source_size, p.target, p.whole,
         CASE WHEN a.ahead::DOUBLE + a.size / 2.0::DOUBLE <= p.target - p.whole * p.source_size::DOUBLE THEN 1 ELSE 0 END AS more
  FROM ahead a JOIN plan p ON a.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, k.source_size, k.target, ((k.whole + k.more) * s.size)::BIGINT AS taken
FROM sized s JOIN picked k ON s.source IS NOT DISTINCT FROM k.source AND s.ticket = k.ticket
"""


@_file("op6_mix_sources", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped water-filling over all documents."""
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _quality_twin() -> str:
    """The base statistics said anew in SQL; the estimate's steps are plain SQL on both sides."""
    p = range(1, quality.P + 1)
    parts = {
        "base": r"SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents",
        "spots": "SELECT row, i, w[i:i+7] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)",
        "twice": "SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM spots) WHERE n > 1",
        "covered": "SELECT row, sum(least(8, coalesce(later - i, 8))) AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS later FROM twice) GROUP BY row",
        "lined": r"SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base",
        "stats": r"""
SELECT b.row, doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
       len(l)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
FROM base b JOIN lined USING (row) LEFT JOIN covered c USING (row)""",
        "feats": """
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       floor(ln((word_chars + 250)::DOUBLE / (n_words + 50)::DOUBLE) * 1000 + 0.5)::BIGINT AS x1,
       floor(sqrt(n_symbols::DOUBLE / (word_chars + 100)::DOUBLE) * 1000 + 0.5)::BIGINT AS x2,
       floor(sqrt(n_dup_lines::DOUBLE / (n_lines + 4)::DOUBLE) * 1000 + 0.5)::BIGINT AS x3,
       floor(sqrt(n_repeat_words::DOUBLE / (n_words + 50)::DOUBLE) * 1000 + 0.5)::BIGINT AS x4,
       floor(ln(n_words + 1.0::DOUBLE) * 1000 + 0.5)::BIGINT AS x5,
       coalesce('v' || lang, 'n') || '/' || coalesce('v' || source, 'n') AS own
FROM stats""",
        "numbers": f"SELECT row, grp, {', '.join(f'x{i}' for i in p)} FROM ({quality.grouping_sql('feats')}) q",
        "p0": quality.start_sql("numbers"),
    }
    for k in range(quality.STEPS):
        parts[f"p{k + 1}"] = quality.step_sql("numbers", f"p{k}")
    parts["far"] = quality.distance_sql("numbers", f"p{quality.STEPS}")
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts.items())
    return f"""WITH {ctes}
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {quality.CUTOFF}, false) AS kept
FROM feats f LEFT JOIN far USING (row)"""


@_file("op3_quality_outliers", _quality_twin())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers per language and source over all documents."""
    return quality.verdicts(_table(spark, sf_dir, "documents")).drop("key", "distance")


@_file("op10_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms, and how many values of each kind it had."""
    out = pseudonyms.found(_table(spark, sf_dir, "documents"), key="tidemark")
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", k))).cast("bigint").alias(f"n_{k}") for k in pseudonyms.KINDS]
    return out.select(F.col("row.doc_id").alias("doc_id"), *counts, F.col("made").alias("text"))


@_file("op7_trie_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of their decoding."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return trie_bpe.encoded(_table(spark, sf_dir, "documents"), path, trie_bpe.digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


MARKS = sentence_spans.MARKS
OP4_SQL = rf"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{MARKS}]+[{MARKS}]*|[{MARKS}]+') AS s
  FROM documents),
runs AS (
  SELECT row, doc_id, p, k, n, list_transform(s[p:p + k - 1], lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS run,
         list_sum(list_transform(s[p:p + k - 1], lambda x: strlen(x))) AS size
  FROM (SELECT row, doc_id, s, len(s) AS n, unnest(range(1, len(s) + 1)) AS p FROM base), (VALUES (1), (2), (3)) v(k) WHERE p + k - 1 <= n),
long AS (SELECT row, doc_id, p, k, run FROM runs WHERE size >= CASE k WHEN 1 THEN 120 WHEN 2 THEN 100 ELSE 60 END OR (n = k AND size >= 60)),
later AS (
  SELECT row, p, k FROM (SELECT row, p, k, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, row, p) AS place FROM long) WHERE place > 1),
covered AS (SELECT DISTINCT row, q FROM (SELECT row, unnest(range(p, p + k)) AS q FROM later)),
pieces AS (SELECT row, q, s[q] AS piece FROM (SELECT row, s, unnest(range(1, len(s) + 1)) AS q FROM base)),
kept AS (
  SELECT row, count(c.q) AS n_removed, coalesce(string_agg(CASE WHEN c.q IS NULL THEN piece END, '' ORDER BY q), '') AS text
  FROM pieces LEFT JOIN covered c USING (row, q) GROUP BY row)
SELECT b.doc_id, len(b.s)::BIGINT AS n_sentences, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.text, '') AS text
FROM base b LEFT JOIN kept k USING (row)
"""


@_file("op4_sentence_spans", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of passages that stand elsewhere before."""
    out = sentence_spans.dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_sentences", "n_removed", F.col("made").alias("text"))


@_file("op5_bayes_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates and its number of links."""
    return jaccard.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP2_SQL = r"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lined AS (SELECT row, doc_id, string_split(text, chr(10)) AS l FROM base),
plain AS MATERIALIZED (SELECT row, doc_id, num, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS v
          FROM (SELECT row, doc_id, unnest(range(1, len(l) + 1)) AS num, unnest(l) AS line FROM lined)),
shaped AS MATERIALIZED (SELECT row, doc_id, num, v, regexp_replace(v, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS s FROM plain),
placed AS MATERIALIZED (
  SELECT row, doc_id, num, v, s, len(string_split(s, ' ')) AS n, string_split(s, ' ')[1:3] AS lead FROM shaped WHERE len(string_split(s, ' ')) >= 3),
per_line AS (SELECT s, n, lead, count(DISTINCT row) AS docs FROM placed GROUP BY ALL),
leaves AS (SELECT n, lead FROM per_line GROUP BY n, lead HAVING sum(docs) >= 10),
fields AS MATERIALIZED (
  SELECT s, n, lead, docs, unnest(range(1, n + 1)) AS p, unnest(string_split(s, ' ')) AS token FROM per_line JOIN leaves USING (n, lead)),
common AS (SELECT n, lead, p, token FROM fields WHERE p > 3 GROUP BY ALL HAVING sum(docs) >= 10),
marked AS (
  SELECT f.s, f.p, f.token, f.token <> '<*>' AND (f.p <= 3 OR c.p IS NOT NULL) AS fixed
  FROM fields f LEFT JOIN common c ON f.n = c.n AND f.lead = c.lead AND f.p = c.p AND f.token = c.token),
general AS MATERIALIZED (
  SELECT s, string_agg(CASE WHEN fixed THEN token ELSE '<*>' END, ' ' ORDER BY p) AS template FROM marked GROUP BY s
  HAVING avg(CASE WHEN token <> '<*>' THEN fixed::INT END) >= 0.7),
standing AS (
  SELECT row, doc_id, num, 'template' AS kind, template AS t FROM placed JOIN general USING (s)
  UNION ALL SELECT row, doc_id, num, 'verbatim', v FROM placed WHERE n >= 4),
again AS (
  SELECT kind, t, min(doc_id) AS first FROM standing GROUP BY kind, t HAVING count(DISTINCT row) >= CASE kind WHEN 'template' THEN 10 ELSE 2 END),
gone AS (SELECT DISTINCT row, num FROM standing JOIN again USING (kind, t) WHERE doc_id <> first)
SELECT s.doc_id, count(*)::BIGINT AS n_lines, count(g.num)::BIGINT AS n_dropped,
       coalesce(string_agg(CASE WHEN g.num IS NULL THEN s.line END, chr(10) ORDER BY s.num), '') AS text
FROM plain s LEFT JOIN gone g USING (row, num) GROUP BY s.row, s.doc_id
"""


@_file("op2_line_templates", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    out = templates.dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("made").alias("text"))


@_file("op1_permutation_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return permutation.search(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"))


@_file("op8_toxicity_gru")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a network fitted on the labelled ones that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    texts, toxic = toxicity.sample(docs, labels.where(~held_out))
    scored = toxicity.score(docs, toxicity.fit(texts, toxic))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_file("op9_secret_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; the strings themselves are not repeated."""
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("value").cast("binary"), 256)
    return out.select("doc_id", "start", F.length("value").cast("bigint").alias("length"), digest.alias("value_sha256"), "score", "secret")


@_file("op11_spelling_fm", twins.spelling_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, of which one in 97 lost a letter, with its form and root."""
    return spelling.variants(_table(spark, sf_dir, "documents"), slips=97)


OP12_SQL = """
WITH rows AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM met)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_file("op12_impact_topk", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of largest inner product with every fiftieth one."""
    return impact.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_file("op13_merkle_witness", twins.manifest_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the manifest, verified after a third of the texts were put in lower case."""
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(docs, changed=F.when(hit, lower).otherwise(F.col("text")))


@_file("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to tokens."""
    return corpus_pipeline.run(spark, sf_dir)
