from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from demandspark.llm import mixing


@pytest.mark.parametrize("window_rows", [mixing.WINDOW_ROWS, 2])
def test_the_sample_meets_the_targets(spark, monkeypatch, window_rows):
    # "rare" has 5 % of the tokens and a target of 12 %: at most 42 % of all can be kept.
    rows = spark.createDataFrame(
        [("=rare" if i % 20 == 0 else "=common", ("=en", "=de", "=fr")[(i % 7) % 3], "=legal" if i % 9 == 0 else "=general", 10 + i % 5) for i in range(1800)],
        "source string, lang string, topic string, n_tokens long",
    )
    targets = {"source": {"rare": 0.12, "common": 0.88}, "lang": {"en": 0.4, "de": 0.3, "fr": 0.3}, "topic": {"legal": 0.2, "general": 0.8}}
    if window_rows == 2:  # joins in place of windows
        monkeypatch.setattr(mixing, "CLOSE", 4e-3)
        monkeypatch.setattr(mixing, "_FAR", 4e-3)
    found = mixing.cells(rows, targets, window_rows=window_rows)
    for r in mixing.marginals(found).collect():
        assert r.reached == pytest.approx(targets[r.dim][r.value[1:]], rel=5e-3)
    kept, n, most = found.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens"), F.max("probability")).first()
    assert most <= 1 and 0.3 < kept / n < 0.43


def test_marginals_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keys = {"source": mixing._value(F.col("source")), "lang": mixing._value(F.col("lang")), "topic": mixing._value(mixing.topic_of())}
    found = mixing.cells(docs.select(*[c.alias(d) for d, c in keys.items()], mixing.token_count().alias("n_tokens")))
    rows = mixing.marginals(found).collect()
    assert len(rows) > 8 and all(r.reached == pytest.approx(r.target, rel=5e-3) for r in rows)


def test_targets_out_of_reach_lower_the_kept_share(spark):
    # "a" is to have nearly all and has a twentieth; "b" and "c" only occur together.
    rows = spark.createDataFrame([("=a" if i % 20 == 0 else "=b", "=x", "=c", 10) for i in range(200)], "source string, lang string, topic string, n_tokens long")
    found = mixing.cells(rows, {"source": {"a": 0.9, "b": 0.1}})
    assert {r.value: round(r.reached, 3) for r in mixing.marginals(found).where("dim = 'source'").collect()} == {"=a": 0.9, "=b": 0.1}
    assert mixing.cells(rows.limit(0)).count() == 0
