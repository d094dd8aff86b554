from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from conftest_llm import brute_components, brute_fingerprint
from pyspark.sql import functions as F

from demandspark.llm import components, mixing, sharding, simhash, topk
from demandspark.llm.queries import ORACLE, QUERIES, op5_simhash
from demandspark.llm.store import table

SF = "/root/testdata/sf0.001"


# --- SimHash --------------------------------------------------------------------------------


def test_components_of_the_test_documents(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = {i: (f"{fp:016x}", c) for i, fp, c in zip(ids, fps, brute_components(ids, fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, SF).collect()} == want


def test_fingerprint_edges(docs, edges):
    got = simhash.near_duplicates(docs(edges, clash=True)).collect()
    fps = [brute_fingerprint(t) for _, t in edges]
    want = zip([i for i, _ in edges], [f"{f:016x}" for f in fps], brute_components([i for i, _ in edges], fps))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(docs([])).count() == 0


def test_fingerprints_of_very_many_rows(docs):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text {i % 20} of some more words {i % 20}") for i in range(150)] + [(None, None), (7, "")]
    df = docs(rows, clash=True)
    few, many = ([sorted(map(str, f(df, hot=n).collect())) for n in (simhash.HOT, 5)] for f in (simhash.near_duplicates, simhash.one_of_each))
    assert few[0] == few[1] and len(few[0]) == len(rows)
    assert many[0] == many[1]


@pytest.mark.parametrize("most", [1 << 13, 8, 1])
def test_links_reach_as_far_as_all_pairs(spark, most):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = base[rng.integers(0, 12, 300)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) * rng.integers(0, 2, 300).astype(np.uint64)
    fps = np.unique(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    found = components.components(simhash.links(df, 2, most))
    root = {r.node: r.root for r in found.collect()}
    signed = fps.view(np.int64).tolist()
    got = {}
    for x in signed:
        got.setdefault(root.get(x, x), set()).add(x)
    want = {}
    for x, c in zip(signed, brute_components(signed, fps.tolist())):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_row_of_each_group(docs, edges):
    df = docs(edges, clash=True)
    got = simhash.one_of_each(df)
    fps = [brute_fingerprint(t) for _, t in edges]
    groups = brute_components(list(range(len(edges))), fps)
    assert got.count() == len(set(groups)) and got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect() if r.text and r.text.startswith("twice")) == [3]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 200)]
    got = components.components(spark.createDataFrame(chain + star + [(300, 300)], "a long, b long"))
    root = {r.node: r.root for r in got.collect()}
    assert all(root[i] == 0 for i in range(41)) and all(root[i] == 100 for i in range(100, 200)) and len(root) == 141


# --- top-k ----------------------------------------------------------------------------------


def _plain(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            best = sorted(((sum(x * y for x, y in zip(a, b)), -i) for i, b in ok if i != q and len(a) == len(b)), reverse=True)[:k]
            out |= {(q, r, -i, s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_matches_plain_python(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=19).tolist()) for i in range(350)]
    rows += [(400 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(500, None), (501, [float("nan")] * 19), (502, [None] * 19), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (700, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    queries = df.where("vec_id % 100 = 0")
    want = _plain(rows, 10)
    assert set(map(tuple, topk.top_k(df, queries, 10).collect())) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "ROWS", 64)
    assert set(map(tuple, topk.top_k(df, queries, 10).collect())) == want
    assert topk.top_k(df.limit(0), queries, 10).count() == 0 and topk.top_k(df, queries.limit(0), 10).count() == 0


def test_top_k_of_repeated_ids_and_large_components(spark, tmp_path):
    rows = [(0, [3e6, 1.0]), (0, [-3e6, 2.0]), (1, [3e6, 3.0]), (2, [1e18, 1e18]), (100, [1e18, 1.0]), (3, [2.0, 5.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2).write.parquet(f"{tmp_path}/v")
    got = topk.top_k(spark.read.parquet(f"{tmp_path}/v"), F.col("vec_id") % 100 == 0, 10).collect()
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    held = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for n, (i, a) in enumerate(ints):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(ints) if m != n)
            want += [(i, r, j, held(-s)) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    # From elsewhere: rows of the query's id are left out.
    other = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(spark.read.parquet(f"{tmp_path}/v"), other, 10).orderBy("rank").collect()] == [2, 100, 1, 3]


# --- shards ---------------------------------------------------------------------------------


def _duck(spark_df, sql):
    con = duckdb.connect()
    con.register("documents", spark_df.toArrow())
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("limit", [1 << 22, 20_000, 3_000])
def test_shards_match_sql(spark, limit):
    df = table(spark, SF, "documents")
    got = sharding.shards(df, limit=limit)
    order = "doc_id n_bytes shard depth shard_bytes shard_docs oversize".split()
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(_duck(df, f"SELECT {', '.join(order)} FROM ({sharding.oracle(limit)})"))


def test_shards_of_repeated_rows_stay_under_the_limit(docs, edges):
    rows = [*edges, *[(77, "x" * 100)] * 300]
    got = sharding.shards(docs(rows, clash=True), limit=2_000).collect()
    assert len(got) == len(rows)
    assert all(r.shard_bytes <= 2_000 or r.shard_docs == 1 for r in got)
    assert all(r.oversize == (r.shard_bytes > 2_000) for r in got)
    names = sorted({r.shard for r in got})
    assert not any(b.startswith(a) for a in names for b in names if a != b)  # no shard is inside another
    assert sharding.shards(docs([])).count() == 0
    placed = sharding.with_shard(docs(rows), limit=2_000)
    assert sorted(r.shard for r in placed.collect()) == sorted(r.shard for r in got)
    assert sharding.with_shard(docs(rows, clash=True), limit=2_000, name="part_of").count() == len(rows)


def test_written_shards(docs, tmp_path, spark):
    rows = [(i, "y" * 50) for i in range(100)]
    sharding.write_shards(docs(rows), f"{tmp_path}/out", limit=1_000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    assert back.count() == 100


# --- mixing ---------------------------------------------------------------------------------


def test_marginals_meet_given_targets(docs):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", "a" if i % 2 else "b") for i in range(600)] + [(None, None, None, None), (900, "", None, "a")]
    targets = {"source": {"a": 0.25, "b": 0.75, "absent": 1.0, None: 0.0}, "lang": {"en": 1.0, "de": 1.0}, "topic": {"general": 1.0}}
    df = docs(rows, clash=True).select("doc_id", "text", "lang", "source", "score")
    cells = mixing.cells(
        df.select(F.concat(F.lit("="), "source").alias("source"), F.concat(F.lit("="), "lang").alias("lang"), F.lit("=general").alias("topic"), mixing.token_count().alias("n_tokens")).na.fill("-"),
        targets,
    )
    by = lambda c: {r[0]: r[1] for r in cells.groupBy(c).agg(F.sum("w")).collect()}
    assert by("source")["=a"] == pytest.approx(0.25) and by("source")["=b"] == pytest.approx(0.75)
    assert by("lang")["=en"] == pytest.approx(0.5, abs=1e-6)
    out = mixing.sampled(df, targets)
    assert out.count() == len(rows)
    n, kept = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert kept == pytest.approx(mixing.KEEP * n)
    assert mixing.mixed(df, targets).columns == df.columns
    assert mixing.mixed(df, targets).count() == out.where("kept").count()
    assert mixing.sampled(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [100_000, 2])
def test_many_cells_are_raked_like_few(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast_rows)
    # Few rounds: both ways are to do the same in each.
    monkeypatch.setattr(mixing, "CLOSE", 0.05)
    monkeypatch.setattr(mixing, "_FAR", 0.05)
    rows = spark.createDataFrame(
        [(f"=s{i % 40}", f"=l{i % 3}" if i % 4 else "-", f"=t{i % 5}", 1 + i * i % 97) for i in range(900)] + [("=empty", "-", "=t0", 0)],
        "source string, lang string, topic string, n_tokens long",
    )
    few, many = (
        {(r.source, r.lang, r.topic): r for r in mixing.cells(rows, window_rows=n).collect()} for n in (mixing.WINDOW_ROWS, 10)
    )
    assert few.keys() == many.keys() and len(few) == 100
    for k, r in few.items():
        assert many[k].tokens == r.tokens and many[k].w == pytest.approx(r.w) and many[k].probability == pytest.approx(r.probability)


def test_sampling_follows_the_probabilities(spark):
    got = mixing.sampled(table(spark, "/root/testdata/sf0.1", "documents")).agg(F.avg("probability"), F.avg(F.col("kept").cast("int"))).first()
    assert abs(got[0] - got[1]) < 0.02


# --- registered queries against SQL ----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == names
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall()))
