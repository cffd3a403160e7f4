"""Every operator on hard rows and on an empty table."""

from __future__ import annotations

import random
import re
from collections import Counter

import public_tokenizers
import pytest

from tests.llm.cases import HARD, PROSE, docs
from tidemark.llm import jaccard, mixing, pseudonyms, quality, secret_scan, sentence_spans, templates, toxicity, trie_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

KEEPERS = {
    "quality": quality.keep,
    "templates": templates.keep,
    "jaccard": jaccard.keep_one,
    "mixing": mixing.mix,
    "pseudonyms": lambda d: pseudonyms.pseudonymise(d, key="k"),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_empty_table(spark, name):
    empty = docs(spark).limit(0)
    out = KEEPERS[name](empty)
    assert out.columns == empty.columns and out.count() == 0


@pytest.mark.parametrize("name", KEEPERS)
def test_hard_rows_keep_their_columns(spark, name):
    d = docs(spark)
    out = KEEPERS[name](d)
    assert out.columns == d.columns
    assert set(out.select("doc_id").toPandas().doc_id.dropna().astype(int)) <= {r[0] for r in HARD if r[0] is not None}


def test_quality_rejects_short_texts_only(spark):
    rows = {(r.doc_id, r.n_words): r for r in quality.verdicts(docs(spark)).collect()}
    assert rows[(4, 0)].base_failed and not rows[(4, 0)].kept
    assert not rows[(1, len(PROSE.split()))].base_failed
    long = next(r for k, r in rows.items() if k[0] == 8)
    assert long.n_words == 120_000 and long.n_repeat_words == 120_000 and long.base_failed
    assert next(r for r in rows.values() if r.doc_id == 9 and r.n_words == 3).n_dup_lines == 1


def test_mixing_keeps_wordless_rows_once_and_bounds_repeats(spark):
    out = Counter((r.doc_id, r.text) for r in mixing.mix(docs(spark)).collect())
    rows = Counter((i, t) for i, t, _, _ in HARD)
    for key, n in rows.items():
        words = (key[1] or "").split()
        assert out[key] == n if not words else out[key] <= 2 * n
    plan = mixing.plan_mix(docs(spark)).collect()
    assert len(plan) == len(HARD) and all(r.taken <= 2 * r.size for r in plan)
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in plan)
    # The rows of the plan are those of the mix.
    assert sum(r.repeats for r in plan if r.size) == sum(n for (_, t), n in out.items() if (t or "").split())


def test_sentence_spans_leave_the_first(spark):
    out = {}
    for r in sentence_spans.dedup(docs(spark)).select("row.doc_id", "row.text", "n_removed", "made").collect():
        out.setdefault((r.doc_id, r.text), []).append(r)
    assert out[(1, PROSE)][0].made == PROSE
    assert len(out[(2, PROSE)]) == 2 and all(r.made == "" for r in out[(2, PROSE)])
    # Rows alike in id and text are one document and do not repeat each other.
    assert all(r.n_removed == 0 for r in out[(None, "no id here at all, friend")])
    assert out[(4, None)][0].made is None and out[(5, "")][0].made == ""
    # One word changed: the runs around it stand, those without it go.
    changed = out[(3, PROSE.replace("dog", "cat"))][0]
    assert "cat" in changed.made and changed.n_removed > 0


def brute_spans(rows):
    """The rule said anew, for rows (doc_id, text) of distinct ids: what is left by id."""
    cut = {i: re.findall(r"[^.!?;:,\n]+[.!?;:,\n]*|[.!?;:,\n]+", t) for i, t in rows}
    seen, out = set(), {}
    for i in sorted(cut):
        s, gone = cut[i], set()
        for p in range(len(s)):
            for k in (1, 2, 3):
                size = sum(len(x.encode()) for x in s[p : p + k])
                if p + k <= len(s) and (size >= {1: 120, 2: 100, 3: 60}[k] or (k == len(s) and size >= 60)):
                    run = tuple(x.strip(" \t\n\x0b\x0c\r") for x in s[p : p + k])
                    if run in seen:
                        gone |= set(range(p, p + k))
                    seen.add(run)
        out[i] = "".join(x for p, x in enumerate(s) if p not in gone)
    return out


def test_sentence_spans_find_passages_within_texts(spark):
    """Passages of 50 to 80 words and three to seven clauses, set into foreign words on either side without a mark between."""
    r = random.Random(7)
    made = lambda n: ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n)]
    rows = []
    for i in range(60):
        passage, clauses = made(r.randint(50, 80)), i % 5 + 3
        for k in range(1, clauses):
            passage[len(passage) * k // clauses] += ",.;"[k % 3]
        for j in (0, 1):
            rows.append((2 * i + j, " ".join([*made(r.randint(5, 60)), *passage, *made(r.randint(5, 60))]) + "."))
    out = {x.doc_id: (x.made, x.n_removed) for x in sentence_spans.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows])).select("row.doc_id", "made", "n_removed").collect()}
    assert {i: m for i, (m, _) in out.items()} == brute_spans(rows)
    assert all(out[i][1] == 0 for i in range(0, 120, 2)) and sum(out[i][1] > 0 for i in range(1, 120, 2)) >= 54


def test_sentence_spans_of_hot_runs(spark):
    """One passage in every document, more often than the bar for a broadcast, and runs within one text."""
    rows = [(i, f"Its own opening {i} stands here alone and apart. {PROSE} {PROSE if i % 7 == 0 else ''}") for i in range(90)] + [(100, PROSE)]
    out = {x.doc_id: x.made for x in sentence_spans.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows])).select("row.doc_id", "made").collect()}
    assert out == brute_spans(rows)
    assert sentence_spans.dedup(docs(spark).limit(0)).count() == 0


def test_sentence_spans_know_marks_of_other_scripts(spark):
    passage = "今天的天气非常好我们一起去公园散步。孩子们在草地上奔跑并且大声地笑着！老人坐在长椅上安静地看着远处的湖水，微风轻轻吹过树梢带来花香。"
    rows = [(1, "开头的一句话在这里" + "。" + passage + "结尾甲", "zh", "a"), (2, "另外一个完全不同的开头。" + passage + "末尾乙", "zh", "a")]
    out = {x.doc_id: x.made for x in sentence_spans.dedup(docs(spark, rows)).select("row.doc_id", "made").collect()}
    assert out == {1: rows[0][1], 2: "另外一个完全不同的开头。末尾乙"}


def test_templates_generalise_fields(spark):
    rows = [(i, f"unique start {chr(97 + i)}{chr(98 + i)} text\nUser {i} logged in from host{i} at noon today\nClosing words number {i}{i} of this", "en", "a") for i in range(12)]
    rows += [(50, "User logged in", "en", "a"), (51, None, "en", "a")]
    found, _ = templates.recurring(docs(spark, rows))
    assert {r.template for r in found.collect()} >= {"User <*> logged in from <*> at noon today"}
    out = {r.row.doc_id: r for r in templates.dedup(docs(spark, rows)).collect()}
    assert out[0].n_dropped == 0 and "User 0 logged" in out[0].made  # the first keeps it
    assert all("logged in from" not in out[i].made and f"{chr(97 + i)}{chr(98 + i)}" in out[i].made for i in range(1, 12))
    assert out[50].made == "User logged in" and out[51].made is None


def test_templates_generalise_words_by_their_counts(spark):
    names = "ada bob cyd dan eve fay gus hal ivy jon kit lou".split()
    rows = [(i, f"the daily report was written by {n} for all readers\nbody {n} {n}x", "en", "a") for i, n in enumerate(names)]
    found, _ = templates.recurring(docs(spark, rows))
    assert [r.template for r in found.collect()] == ["the daily report was written by <*> for all readers"]


def test_lines_of_two_documents_recur_as_they_stand(spark):
    rows = [(1, "one of its own\nThis work is free.\n12 34 x 56", "en", "a"), (2, "This  work is free. \nanother one here\n12 34 x 56\n12 35 x 56", "en", "a"), (3, "twice here\ntwice here", "en", "a")]
    rows += [(4, "of one document only", "en", "a"), (4, "of one document only", "en", "a"), (None, "twice\n\n12 35 x 56", "en", "a")]
    out = {r.row.doc_id: r for r in templates.dedup(docs(spark, rows)).collect()}
    assert out[2].made == "another one here\n12 35 x 56" and out[2].n_dropped == 2 and out[None].made == "twice\n"
    assert all(out[i].n_dropped == 0 for i in (1, 3, 4))


def test_lines_of_few_tokens_stay(spark):
    rows = [(i, f"{'abcdefghijklmno'[i]} line\n}}\nYes\nend of\n7 8", "en", "a") for i in range(15)]
    assert all(r.n_dropped == 0 for r in templates.dedup(docs(spark, rows)).collect())


def brute_lines(rows, least_docs=10):
    """The rule said anew, for rows (doc_id, text) of distinct ids: kept lines by id."""
    lines = [(i, n, " ".join(x.split())) for i, t in rows for n, x in enumerate(t.split("\n"))]
    shape = lambda x: tuple("<*>" if re.search("[0-9]", w) else w for w in x.split())
    holders: dict = {}
    for i, _, x in lines:
        if len(x.split()) >= 3:
            holders.setdefault(shape(x), set()).add(i)
    leaf = lambda s: (len(s), s[:3])
    load, common = Counter(), Counter()
    for s, ids in holders.items():
        load[leaf(s)] += len(ids)
    for s, ids in holders.items():
        if load[leaf(s)] >= least_docs:
            for p, w in enumerate(s):
                common[leaf(s), p, w] += len(ids)
    made = {}
    for s in holders:
        plain = [(p, w) for p, w in enumerate(s) if w != "<*>"]
        fixed = {p for p, w in plain if p < 3 or common[leaf(s), p, w] >= least_docs}
        if load[leaf(s)] >= least_docs and plain and len(fixed) >= 0.7 * len(plain):
            made[s] = tuple(w if p in fixed else "<*>" for p, w in enumerate(s))
    marks = [(i, n, m) for i, n, x in lines for m in ([made.get(shape(x))] if len(x.split()) >= 3 else []) + ([x] if len(x.split()) >= 4 else []) if m is not None]
    at: dict = {}
    for i, _, m in marks:
        at.setdefault(m, set()).add(i)
    gone = {(i, n) for i, n, m in marks if len(at[m]) >= (2 if isinstance(m, str) else least_docs) and i != min(at[m])}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(11)
    words = "the a report of user host was seen at door red blue 7 x9 2024".split()
    made = [" ".join(r.choice(words[:4] if p < 3 else words) for p in range(r.randint(1, 7))) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(made) for _ in range(r.randint(1, 12)))) for i in range(60)]
    out = {x.row.doc_id: x.made for x in templates.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert out == brute_lines(rows)


def test_templates_of_mostly_digit_fields(spark):
    """Fields with digits may be most of a line; lines of nothing else have no template."""
    lines = lambda i: f"Page {i} of {i + 90}\nCopyright {1990 + i} Acme\nPosted on {i + 1} March {2000 + i}\n{i}-01 {i}:00 id{i} done\n{i} {i + 7}"
    rows = [(i, f"{lines(i)}\nown words {chr(97 + i)}{chr(98 + i)}", "en", "a") for i in range(12)]
    out = {r.row.doc_id: r for r in templates.dedup(docs(spark, rows)).collect()}
    assert out[0].made == rows[0][1]
    assert all(out[i].made == f"{i} {i + 7}\nown words {chr(97 + i)}{chr(98 + i)}" for i in range(1, 12))


def test_jaccard_classes(spark):
    out = {}
    for r in jaccard.classes(docs(spark)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[1][0].class_id == 1 and out[1][0].n_links == 2  # both rows of id 2
    assert all(r.class_id == 1 for r in out[2])
    assert out[4][0].class_id == 4 and out[5][0].n_links == 0 and out[6][0].class_id == 6
    assert {r.n_links for r in out[None]} == {1} and {r.class_id for r in out[None]} == {None}
    kept = Counter(r.doc_id for r in jaccard.keep_one(docs(spark)).collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[None] == 1 and kept[4] == kept[5] == kept[6] == 1 and kept[9] == 2


def test_pseudonyms_leave_other_text(spark):
    out = Counter((r.doc_id, r.text) for r in pseudonyms.pseudonymise(docs(spark), key="k").collect())
    assert out == Counter((i, t) for i, t, _, _ in HARD)


def test_encoding_and_scores(spark):
    out = trie_bpe.encode(docs(spark), VOCABULARY).collect()
    codec = trie_bpe.Codec(trie_bpe.read_tables(VOCABULARY))
    assert Counter((r.doc_id, codec.decode(r.ids)) for r in out) == Counter((i, t or "") for i, t, _, _ in HARD)
    scores = toxicity.score(docs(spark), toxicity.fit([], [])).collect()
    assert len(scores) == len(HARD) and all(0 <= r.score < 0.5 for r in scores)
    assert trie_bpe.encode(docs(spark).limit(0), VOCABULARY).count() == 0 and toxicity.score(docs(spark).limit(0), toxicity.fit([], [])).count() == 0


def test_secret_scan_without_candidates(spark):
    assert secret_scan.scan(docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "plain words only", "en", "a")])).count() == 0
    one = secret_scan.scan(docs(spark, [(1, "a key aaaabbbbccccdddd1", "en", "a")])).collect()
    assert [(r.start, r.secret) for r in one] == [(6, True)]  # nothing to learn from: nothing is removed
