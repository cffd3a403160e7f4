"""SQL twins that are built from parts: checksums of texts, trees of digests, words one edit apart."""

from __future__ import annotations

#: The 256 remainders of the CRC-32 polynomial, and the checksum of a list of bytes ``{b}``.
CRC_TABLE = """SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"
#: The bytes of a text, from its hexadecimal form.
BYTES = "list_transform(range(1, 2 * octet_length(encode({t})), 2), lambda i: ('0x' || substr(hex(encode({t})), i, 2))::BIGINT)"


def crc32(text: str) -> str:
    return CRC.format(b=BYTES.format(t=text))


def manifest_sql(levels: int = 8, upper: int = 4) -> str:
    """The tree level by level: ``levels`` of a language's rows, ``upper`` of the languages."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    without = "left(w.whole, t.turn * 64) || {own} || substr(w.whole, t.turn * 64 + 65)"
    parts = {
        "crc": CRC_TABLE,
        "leaves": f"SELECT doc_id, coalesce('v' || lang, 'n') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS tried FROM documents, crc",
        "a0": "SELECT *, leaf AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves",
    }

    def climb(name: str, k: int) -> None:
        parts[f"{name}w{k}"] = f"SELECT tree, pos // 8 AS pos, n, string_agg(node, '' ORDER BY pos) AS whole FROM {name}{k} GROUP BY tree, pos // 8, n"
        parts[f"{name}{k + 1}"] = f"SELECT tree, pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(whole) ELSE whole END AS node FROM {name}w{k}"

    for k in range(levels):
        climb("a", k)
    parts["b0"] = f"SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{levels}"
    for k in range(upper):
        climb("b", k)
    parts["f0"] = "SELECT row_number() OVER () AS row, doc_id, leaf, tree, pos, tried AS cur, '' AS proof, NULL::VARCHAR AS subroot FROM a0"
    last = "f0"
    for name, k in [("a", k) for k in range(levels)] + [("b", k) for k in range(upper)]:
        if (name, k) == ("b", 0):
            parts["g"] = f"SELECT f.row, f.doc_id, f.leaf, '' AS tree, b.pos, f.cur, f.proof, b.node AS subroot FROM {last} f JOIN b0 b ON f.tree = b.name"
            last = "g"
        now = f"{name}f{k + 1}"
        parts[now] = f"""SELECT t.row, t.doc_id, t.leaf, t.tree, t.pos // 8 AS pos, CASE WHEN w.n > 1 THEN sha256({without.format(own='t.cur')}) ELSE t.cur END AS cur,
  t.proof || CASE WHEN w.n > 1 THEN {without.format(own="''")} ELSE '' END AS proof, t.subroot
  FROM (SELECT *, (pos % 8)::BIGINT AS turn FROM {last}) t JOIN {name}w{k} w ON t.tree = w.tree AND t.pos // 8 = w.pos"""
        last = now
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts.items())
    return f"""WITH {ctes}
SELECT f.doc_id, f.leaf, f.subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = r.node AS verified
FROM {last} f, b{upper} r"""


def spelling_sql() -> str:
    """Words one edit apart: one is the other without a character, or both are alike without the same one."""
    return f"""WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
once AS MATERIALIZED (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, c, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM once, crc),
slipped AS (SELECT c, CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
without AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
paths AS (
  SELECT word, word AS at FROM formed
  UNION SELECT p.word, f.form FROM paths p JOIN formed f ON p.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN paths p USING (word) JOIN formed e ON p.at = e.word WHERE e.form IS NULL"""
