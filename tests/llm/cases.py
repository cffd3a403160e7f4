"""Hard rows every operator is tried on."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, at int, size int, ids int, links int, _key int"

LONG = " ".join(f"word{i % 977} go" for i in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog near the old mill by the river bank. It never looks back at all, not once in years. Then night falls on the quiet hills again."


def docs(spark, rows=None):
    """Rows with NULLs, empty, blank, long and repeated texts, NULL and repeated ids, and columns whose names operators use."""
    rows = HARD if rows is None else rows
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "r", "k", 1, 2, 3, 4, 5) for i, t, lang, src in rows], SCHEMA).repartition(3)


HARD = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE.replace("dog", "cat"), "en", "b"), (4, None, "en", "b"),
    (5, "", None, "b"), (6, " \n\t ", "en", None), (7, "word", "en", "a"), (8, LONG, "en", "c"), (None, "no id here at all, friend", None, None),
    (None, "no id here at all, friend", None, None), (9, "a\n\na\nb", "de", "a"), (9, "other text of the same id", "de", "a"), (10, "😀 中文 é x <|endoftext|>", "zz", "d"),
]
