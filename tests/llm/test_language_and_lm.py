from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm import languageid, lm
from demandspark.llm.queries import op1_language_id, op2_lm_score
from demandspark.llm.store import table

SF = "/root/testdata/sf0.01"


def test_codewords_tell_all_languages_apart():
    for n in (2, 3, 5, 6, 12):
        code = languageid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)
        assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, SF).join(table(spark, SF, "documents"), "doc_id").where("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.98


def test_language_edges(docs, edges):
    rows = [(i, t, "en", "s") for i, t in edges] + [(50, "der die und das ist nicht", "de", "s"), (51, "the and of is not", "en", "s")]
    df = docs(rows, clash=True)
    model = languageid.fit(df)
    got = languageid.predict(df, model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[2] == by[7] == by[1] == "und" and by[50] == "de"
    assert languageid.predict(docs([]), model).count() == 0
    nothing = languageid.fit(docs([(1, "text", None, None)]))
    assert [r.lang_pred for r in languageid.predict(docs([(1, "text")]), nothing).collect()] == ["und"]
    one = languageid.fit(docs([(1, "text", "en")]))
    assert [r.lang_pred for r in languageid.predict(docs([(1, "text")]), one).collect()] == ["en"]


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", _lower(text)), None]


def _base(rows, learn):
    counts = Counter(t for (i, text), yes in zip(rows, learn) if yes for t in _tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        ts = _tokens(text)
        out.append((len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)))
    return out


@pytest.mark.parametrize("hot", [lm.HOT, 3, 0])
def test_base_counts_match_plain_python(docs, edges, hot, monkeypatch):
    monkeypatch.setattr(lm, "HOT", hot)
    rows = [*edges, (8, "The the THE of"), (9, "unseen words only here"), (9, "the the unseen")]
    learn = [i is not None and i % 3 != 0 for i, _ in rows]
    got = lm.scored(docs(rows, clash=True), F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)), (F.col("doc_id") % 3 == 0).alias("held_out"))
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect())
    assert got == sorted((a, b, c, round(d, 6)) for a, b, c, d in _base(rows, learn))


def test_model_is_normalised_and_beats_the_base(spark):
    got = op2_lm_score(spark, SF)
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    m = lm.fit(np.random.default_rng(0).poisson(0.01, (lm.CLASSES, lm.CLASSES)).astype(float), rounds=3)
    assert np.allclose((10 ** m.log10()).sum(1), 1)


def test_probabilities_of_all_tokens_sum_to_one(docs):
    """After any text, over every known token, the end, and one unseen word per class."""
    rows = [(1, "a b c d a b"), (2, "a c e f"), (4, "b a")]
    known = ["a", "b", "c", "d", "e", "f"]
    asked = [(10 + k, w) for k, w in enumerate(known)] + [(20, "")]
    learn, held = F.col("doc_id") < 10, F.lit(True).alias("held_out")
    got = {r.doc_id: r.score for r in lm.scored(docs(rows + asked), learn, held).collect()}
    # All six words are common, so they have classes of their own and no discount.
    scorer, _ = lm._trained(docs(rows), "text", F.lit(True))
    p = 10 ** scorer.model.log10()
    shares = p[0, 0] + p[0, 1:7].sum() + p[0, 7:].sum()
    assert abs(shares - 1) < 1e-9
    assert all(got[10 + k] < 0 for k in range(6)) and abs(10 ** got[20] - p[0, 0]) < 1e-9


def test_lm_without_learning_rows(docs):
    got = lm.scored(docs([(1, "a b"), (2, None)]), F.lit(False), F.lit(True).alias("held_out")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lm.scored(docs([]), F.lit(True), F.lit(True).alias("held_out")).count() == 0
