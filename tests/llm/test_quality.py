from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest import text_of
from pyspark.sql import functions as F

from demandspark.llm import quality

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if n[x] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    found = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
    return (*found, len(w) < 50 or 100 * len(repeated) > 50 * len(w))


TEXTS = [
    None, "", " \n\t", "one two", "a b c a b c a b c", "a a a a", "x y x y x y x", text_of(300, 2), text_of(40, 1) + "\n" + text_of(40, 1),
    "é ß ñ\x0bü\x0cö\r\nzwei 𝒳𝒴", "a\n\na\n a\n" * 30, "# * $ % & | < >" * 20, "w" * 20_000, text_of(20_000, 3), "HELLO THERE " * 40, "1234 5678 9 " * 50,
    "\n".join(f"- item {i} {text_of(3, i)}" for i in range(40)), "\n".join(f"{text_of(5, i)} ..." for i in range(30)), "\x00 \x01 ...",
]


def test_counts_against_plain_python(spark, docs, edges):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + edges
    got = quality.judged(docs(rows, clash=True)).collect()
    assert sorted(((r.doc_id, *(r[c] for c in BASE)) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_verdict_does_not_depend_on_the_order(spark, docs):
    df = docs([(i, t) for i, t in enumerate(TEXTS)])
    t = F.coalesce("text", F.lit(""))
    both = df.select("doc_id", quality.passes(t, quality.RULES).alias("a"), quality.passes(t, quality.RULES[::-1]).alias("b")).collect()
    assert all(r.a == r.b for r in both) and {r.a for r in both} == {True, False}
    kept = {r.doc_id for r in quality.judged(df).where("kept").collect()}
    good = quality.good(df)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} == kept and kept
    assert quality.good(df.limit(0)).count() == 0


def test_each_rule_rejects_its_case_and_prose_stays(spark, docs):
    cases = {
        "mean_word_length": "a " * 60, "symbols": "word # " * 60, "few_letters": "12,. ab;; " * 30, "digits": "ab 12345 c " * 30, "upper_case": "LOUD WORDS here " * 20,
        "duplicate_lines": "the same line\n" * 30, "bullet_lines": "- a line\n" * 30, "cut_lines": "a line ...\n" * 30,
    }
    for rule in quality.RULES:
        got = docs([(1, cases[rule.name]), (2, text_of(300, 5)), (3, "Straße größer übermäßig naïve déjà vu. " * 9)]).select("doc_id", rule.rejects(F.col("text")).alias("x")).collect()
        assert {r.doc_id for r in got if r.x} == {1}, rule.name


def test_order_is_by_rejections_per_second(spark, docs):
    cheap = quality.Rule("never", lambda t: F.length(t) < 0)
    always = quality.Rule("always", lambda t: F.length(t) >= 0)
    found = quality.measured(docs([(i, text_of(50, i)) for i in range(50)]), (cheap, always))
    assert [m.rule.name for m in found] == ["always", "never"] and [m.rejected for m in found] == [1.0, 0.0]
    assert [m.gain for m in found] == sorted((m.gain for m in found), reverse=True)


def test_a_rejected_text_costs_no_later_rule(spark, docs):
    boom = quality.Rule("boom", lambda t: F.raise_error(F.lit("evaluated")).cast("boolean"))
    always = quality.Rule("always", lambda t: F.length(t) >= 0)
    df = docs([(1, "a"), (2, "b")])
    assert not any(r.x for r in df.select(quality.passes(F.col("text"), (always, boom)).alias("x")).collect())
    with pytest.raises(Exception, match="evaluated"):
        df.select(quality.passes(F.col("text"), (boom, always)).alias("x")).collect()
