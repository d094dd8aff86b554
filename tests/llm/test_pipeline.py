from __future__ import annotations

import corpus_pipeline
from conftest_llm import brute_components, brute_fingerprint, brute_overlap

from demandspark.llm import simhash
from demandspark.llm.store import table

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        kept[name] = (before.select("doc_id", "text").collect(), docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert set(r.doc_id for r in docs.collect()) <= set(r.doc_id for r in kept[name][0])
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    rows, after = kept["near_duplicates"]
    fps = [brute_fingerprint(r.text) for r in rows]
    assert ids(after) == sorted(set(brute_components([r.doc_id for r in rows], fps)))

    rows, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    plain = brute_overlap([(r.doc_id, r.text) for r in rows], items, 13)
    assert ids(after) == sorted(p[0] for p in plain if not p[5])

    rows, after = kept["sharding"]
    assert ids(after) == sorted(r.doc_id for r in rows) and set(after.columns) == {*columns, "shard"}


def test_near_duplicate_stage_keeps_op5s_components(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, docs, SF).collect())
    assert got == sorted(set(brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])))
    assert got == sorted(r.component_id for r in simhash.near_duplicates(docs).select("component_id").distinct().collect())


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert 0 < got.count() < table(spark, SF, "documents").count()


def test_stages_take_odd_rows(spark, docs, edges, tmp_path):
    df = docs([(i, t, "en", "s") for i, t in edges]).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "1 as score")
    for name, stage in corpus_pipeline.STAGES:
        for part in (df, df.limit(0)):
            part.write.mode("overwrite").parquet(f"{tmp_path}/in-{name}")
            got = stage(spark, spark.read.parquet(f"{tmp_path}/in-{name}"), SF)
            assert got.count() <= len(edges) and [c for c in got.columns if c != "shard"] == df.columns
