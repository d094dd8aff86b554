"""Ordered-series operators: hand cases, brute force, and equality of the layouts."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from demandspark.operators import ordered as o
from demandspark.operators.ordered import OrderedFrame, SeriesSpec

OPS = [
    o.lag("v", 0, "lag0"),
    o.lag("v", 1, "lag1"),
    o.lag("v", 5, "lag5"),
    o.lead("v", 2, "lead2"),
    o.difference("v", 3, "diff3"),
    o.rolling_mean("v", 3, "mean3"),
    o.rolling_median("v", 3, "med3"),
    o.rolling_median("v", 4, "med4"),
]


def _series(n=400, hot=0.5, keys=9, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.randrange(1, keys)
        # Few distinct t values, so that the second order column matters.
        rows.append((k, rnd.randrange(n // 8), i, None if rnd.random() < 0.3 else rnd.randrange(50)))
    return rows


def _brute(rows, keyed):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0] if keyed else 0, []).append(r)
    out = {}
    for g in groups.values():
        vs = [r[3] for r in g]
        total = None
        low = None
        for i, r in enumerate(g):
            at = lambda j: vs[j] if 0 <= j < len(vs) else None
            win = lambda w: vs[i - w + 1 : i + 1] if i >= w - 1 else None
            full = lambda w, f: f(win(w)) if win(w) and None not in win(w) else None
            total = total if vs[i] is None else (total or 0) + vs[i]
            low = low if vs[i] is None else vs[i] if low is None else min(low, vs[i])
            out[r[2]] = (
                at(i),
                at(i - 1),
                at(i - 5),
                at(i + 2),
                None if at(i) is None or at(i - 3) is None else at(i) - at(i - 3),
                full(3, statistics.fmean),
                full(3, statistics.median),
                full(4, statistics.median),
                next((x for x in reversed(vs[: i + 1]) if x is not None), None),
                next((x for x in vs[i:] if x is not None), None),
                i,
                total,
                low,
            )
    return out


def _spark_result(spark, rows, spec):
    df = spark.createDataFrame(rows, "k int, t int, id int, v int").repartition(3)
    df = df.withColumn("ff", F.col("v")).withColumn("bf", F.col("v"))
    s = OrderedFrame(df, spec).with_ops(OPS).forward_fill(["ff"]).backward_fill(["bf"])
    s = s.row_index("ix").running_sum("v", "rs").running_min("v", "rm")
    names = [*[op.name for op in OPS], "ff", "bf", "ix", "rs", "rm"]
    return {r["id"]: tuple(r[n] for n in names) for r in s.df.collect()}, s


def _same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], nan_ok=True) if None not in want[k] else all(
            (a is None) == (b is None) and (a is None or a == pytest.approx(b))
            for a, b in zip(got[k], want[k])
        ), (k, got[k], want[k])


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("mode,max_rows", [("plain", 10), ("chunked", 40), ("chunked", 3), ("auto", 60)])
def test_layouts_match_brute_force(spark, keyed, mode, max_rows):
    rows = _series()
    spec = SeriesSpec(("t", "id"), ("k",) if keyed else (), max_rows, mode)
    got, frame = _spark_result(spark, rows, spec)
    assert frame.chunked == (mode != "plain")
    _same(got, _brute(rows, keyed))


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("max_rows", [3, 40])
def test_more_chunks_than_literals(spark, monkeypatch, keyed, max_rows):
    monkeypatch.setattr(o, "LITERALS", 4)
    rows = _series()
    spec = SeriesSpec(("t", "id"), ("k",) if keyed else (), max_rows, "chunked")
    got, frame = _spark_result(spark, rows, spec)
    assert frame.chunked
    _same(got, _brute(rows, keyed))


@pytest.mark.parametrize("literals", [5_000, 7])
def test_rows_per_chunk_do_not_grow_with_the_chunk_count(spark, monkeypatch, literals):
    monkeypatch.setattr(o, "LITERALS", literals)
    for n in (2_000, 20_000):
        df = spark.range(n).select(F.xxhash64("id").alias("t"), "id")
        s = OrderedFrame(df, SeriesSpec(("t", "id"), (), 50, "chunked"))
        sizes = [r["count"] for r in s._df.groupBy(o._CHUNK).count().collect()]
        assert sum(sizes) == n and len(sizes) > 0.9 * n / 50
        # Every second row is sampled: neighbouring boundaries are about max_rows apart.
        assert max(sizes) <= 2 * 50


@pytest.mark.parametrize("literals", [5_000, 3])
def test_null_and_nan_boundaries(spark, monkeypatch, literals):
    monkeypatch.setattr(o, "LITERALS", literals)
    rows = [(None if i % 5 == 0 else float("nan") if i % 5 == 1 else float(i % 7), i) for i in range(90)]
    df = spark.createDataFrame(rows, "k double, i int").withColumn("t", F.timestamp_seconds(F.col("i") * 3600))
    res = {}
    for mode in ("plain", "chunked"):
        s = OrderedFrame(df, SeriesSpec(("t",), ("k",), 4, mode)).with_ops([o.lag("i", 7, "l"), o.lead("i", 6, "d")])
        res[mode] = sorted((r["i"], r["l"], r["d"], r["ix"]) for r in s.row_index("ix").df.na.fill(-1, ["l", "d"]).collect())
    assert res["plain"] == res["chunked"]


def test_auto_stays_plain_without_hot_key(spark):
    rows = _series(hot=0.0, keys=200)
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    assert not OrderedFrame(df, SeriesSpec(("t", "id"), ("k",), 60)).chunked
    assert not OrderedFrame(df, SeriesSpec(("t", "id"), (), 1000)).chunked


def test_null_keys_and_timestamps(spark):
    rows = [(None if i % 3 else "a", i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int").select(
        "k", F.timestamp_seconds(F.col("i") * 3600).alias("t"), F.col("i").alias("v")
    )
    res = {}
    for mode in ("plain", "chunked"):
        s = OrderedFrame(df, SeriesSpec(("t",), ("k",), 4, mode)).with_ops([o.lag("v", 7, "l"), o.lead("v", 6, "d")])
        res[mode] = sorted((r["v"], r["l"], r["d"]) for r in s.row_index("ix").df.na.fill(-1).collect())
    assert res["plain"] == res["chunked"]


def test_bad_arguments(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        SeriesSpec(())
    with pytest.raises(ValueError):
        OrderedFrame(df, SeriesSpec(("nope",)))
    with pytest.raises(ValueError):
        o.lag("id", -1)


def test_chunked_plan_keeps_base_rows_off_one_task(spark):
    rows = _series()
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    s = OrderedFrame(df, SeriesSpec(("t", "id"), (), 40, "chunked")).with_ops(OPS)
    plan = s.df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    # All bounded-reach columns share one window node.
    assert plan.count("Window [") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, t int, v int")
    s = OrderedFrame(df, SeriesSpec(("t",), ("k",), 5, "chunked")).with_ops([o.lag("v", 1, "l")])
    assert s.row_index("ix").df.count() == 0
