"""Features, splits, profile, exploration, evaluation on hand tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from demandspark.config import FeatureConfig
from demandspark.operators import evaluate as ev
from demandspark.operators import explore as ex
from demandspark.operators import profile as pf
from demandspark.operators import quantiles as q
from demandspark.operators import split as sp
from demandspark.operators.ordered import OrderedFrame, SeriesSpec
from demandspark.plans import features as ft
from demandspark.plans import models as md

T = SeriesSpec(("t",))


def series(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "t int, v double")


def test_target(spark):
    df = series(spark, [5.0, 10.0, 15.0, 20.0])
    rows = ft.target_column(OrderedFrame(df, T), "v").df.orderBy("t").collect()
    assert [r["target"] for r in rows] == [10, 15, 20, 20]


def test_fill_strategies(spark):
    df = series(spark, [None, 1.0, None, 4.0, None])
    want = {
        None: [None, 1, None, 4, None],
        "forward": [None, 1, 1, 4, 4],
        "backward": [1, 1, 4, 4, None],
        "min": [1, 1, 1, 4, 1],
        "max": [4, 1, 4, 4, 4],
        "mean": [2.5, 1, 2.5, 4, 2.5],
        "zero": [0, 1, 0, 4, 0],
        "one": [1, 1, 1, 4, 1],
    }
    for strategy, values in want.items():
        out = ft.fill_nulls(df, strategy, T).orderBy("t").collect()
        assert [r["v"] for r in out] == values, strategy
    with pytest.raises(ValueError):
        ft.fill_nulls(df, "middle")


def hours(spark, n=60, keys=1):
    rnd = random.Random(3)
    rows = [
        (k, i, 1, 0, 1, i % 24, 0, (i // 24) % 7, 1, 1 + i % 4, rnd.random(), 0.5, rnd.random(), 0.1, 1, i, None if rnd.random() < 0.1 else rnd.randrange(99))
        for k in range(keys)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "k int, datetime int, season bigint, yr bigint, mnth bigint, hr bigint, holiday bigint, weekday bigint, workingday bigint, "
        "weathersit bigint, temp double, atemp double, hum double, windspeed double, casual bigint, registered bigint, cnt bigint",
    )


def test_feature_layouts_agree(spark):
    df = hours(spark, keys=3)
    t = ft.fit_thresholds(df)
    out = {}
    for mode in ("plain", "chunked"):
        spec = SeriesSpec(("datetime",), ("k",), 40, mode)
        feats = ft.build_features(df, spec, FeatureConfig(), t, keep=["datetime"])
        out[mode] = sorted(str(r) for r in feats.collect())
    assert out["plain"] == out["chunked"]
    assert "cnt_lag_24hr" in feats.columns and "cnt" not in feats.columns and "target" in feats.columns
    with pytest.raises(ValueError):
        ft.build_features(df.drop("yr"), SeriesSpec(("datetime",), ("k",)))


@pytest.mark.parametrize("test,val,sizes", [(0.1, 0.1, (81, 10, 9)), (0.2, 0.2, (61, 20, 19)), (0.0, 0.5, (51, 49, 0))])
def test_split_sizes(spark, test, val, sizes):
    df = series(spark, [float(i) for i in range(100)])
    for spec in (T, SeriesSpec(("t",), max_rows=30, mode="chunked")):
        parts = sp.split_train_val_test(df, spec, test, val)
        assert tuple(p.count() for p in parts) == sizes
        assert parts[0].agg(F.max("t")).first()[0] == sizes[0] - 1


def test_split_errors(spark):
    df = series(spark, [1.0])
    for bad in ((-0.1, 0.2), (0.5, 0.5), (0.2, 1.1)):
        with pytest.raises(ValueError):
            sp.split_train_val_test(df, T, *bad)
    with pytest.raises(ValueError):
        sp.combine_rows(df, df.withColumn("w", F.lit(1)))
    with pytest.raises(ValueError):
        sp.fold_bounds(10, 3, 4)


def test_folds(spark):
    out = sp.expanding_folds(series(spark, [0.0] * 10), T, 2, 3)
    got = {(r["fold"], r["role"]): r["n"] for r in out.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "train"): 4, (0, "test"): 3, (1, "train"): 7, (1, "test"): 3}


@pytest.mark.parametrize("max_rows", [q.MAX_ROWS, 50])
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_exact_quantiles_brute(spark, max_rows, method):
    rnd = random.Random(5)
    cols = {
        "a": [rnd.random() for _ in range(701)],
        "hot": [1.0 if rnd.random() < 0.4 else rnd.gauss(0, 3) for _ in range(701)],
        "gaps": [None if rnd.random() < 0.3 else float(rnd.randrange(9)) for _ in range(701)],
        "none": [None] * 701,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), "a double, hot double, gaps double, none double")
    probs = [0.0, 0.25, 0.5, 0.8, 0.999, 1.0]
    got = q.exact_quantiles(df, list(cols), probs, method, max_rows)
    for c, values in cols.items():
        v = sorted(x for x in values if x is not None)
        for p, g in zip(probs, got[c]):
            if not v:
                assert g is None
                continue
            pos = p * (len(v) - 1)
            lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
            want = lo + (hi - lo) * (pos - math.floor(pos)) if method == "linear" else v[math.floor(pos + 0.5)]
            assert g == pytest.approx(want, abs=1e-12), (c, p)


def test_grouped_quantiles_chunked(spark):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(4)}", rnd.randrange(40) / 3) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    small, big = (
        sorted(tuple(r) for r in q.grouped_quantiles(df, ["v"], {"m": 0.5, "p": 0.9}, ["g"], max_rows=m).collect())
        for m in (10_000, 40)
    )
    assert small == big and len(small) == 5


def test_profile_edges(spark):
    schema = "a bigint, b double, s string"
    empty = spark.createDataFrame([], schema)
    assert pf.numeric_summary(empty).count() == 0 and pf.categorical_summary(empty).count() == 0
    assert pf.duplicated_rows(empty).first()[0] == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, schema)
    row = pf.numeric_summary(nulls, ["b"]).first()
    assert (row["count"], row["missing_values"], row["missing_pct"], row["unique_values"], row["mode"]) == (0, 3, 1.0, 1, [])
    assert pf.duplicated_rows(nulls).first()[0] == 3 and pf.duplicated_rows(nulls, "extra").first()[0] == 2
    one = spark.createDataFrame([(7, 1.5, "x")], schema)
    row = pf.numeric_summary(one, ["a"]).first()
    assert (row["mean"], row["std"], row["mode"]) == (7.0, None, [7.0])
    big = spark.createDataFrame([(2**53, 0.0, "x"), (2**53 + 1, 0.0, "x")], schema)
    assert {r["column"]: r["unique_values"] for r in pf.cardinality(big).collect()} == {"a": 2, "b": 1, "s": 1}
    ties = spark.createDataFrame([(i, float(i % 8), "t") for i in range(16)], schema)
    assert pf.numeric_summary(ties, ["b"]).first()["mode"] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_profile_takes_own_checks(spark):
    own = lambda d: d.agg(F.max("v").alias("value")).selectExpr("'v' as column", "'top' as metric", "value", "'' as text")
    rows = pf.profile(series(spark, [1.0, 9.0]), [own, pf.check_shape]).collect()
    assert {r["metric"]: r["value"] for r in rows}["top"] == 9.0 and len(rows) == 5


def test_explore_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", True)] * 4 + [(1.0, 3.0, "b", False)], "c double, d double, g string, f boolean")
    r = {(x["a"], x["b"]): x["r"] for x in ex.pearson_matrix(df).collect()}
    assert r == {("c", "c"): None, ("c", "d"): None, ("d", "c"): None, ("d", "d"): 1.0}
    assert ex.flag_outliers(df, "c", "zscore").where("is_outlier").count() == 0
    assert ex.outlier_rows(df, ["d"], "iqr", only_outliers=True).collect()[0]["value"] == 3.0
    ent = {x["column"]: x["entropy"] for x in ex.categorical_summary(df).collect()}
    assert ent["g"] == ent["f"] == round(-(0.8 * math.log10(0.8) + 0.2 * math.log10(0.2)), 2)
    with pytest.raises(ValueError):
        ex.pearson_matrix(df.select("c"))
    with pytest.raises(ValueError):
        ex.group_analysis(df, "d")
    assert ex.histogram(df, ["c"]).collect()[0]["n"] == 5


def test_spearman_salted_join(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(0.0 if rnd.random() < 0.4 else rnd.random(), rnd.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    want = {(r["a"], r["b"]): r["r"] for r in ex.spearman_matrix(df).collect()}
    monkeypatch.setattr(ex, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(ex, "SALT_ROWS", 20)
    got = {(r["a"], r["b"]): r["r"] for r in ex.spearman_matrix(df).collect()}
    assert got == pytest.approx(want)


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 6.0)], "y double, yhat double")
    m = ev.regression_metrics(df, n_features=1).first()
    assert (m["MAE"], m["RMSE"]) == (1.33, 1.41)
    assert m["MAPE"] == round((1 / 0.01 + 0.5 + 0.5) / 3 * 100, 2)
    assert m["Adjusted_R2"] == -0.5
    assert ev.regression_metrics(df).first()["Adjusted_R2"] is None
    assert ev.regression_metrics(df, n_features=2).first()["Adjusted_R2"] is None


def test_pick_best_and_champions(spark):
    m = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1000.0)], "model string, RMSE double")
    pos = spark.createDataFrame([("a", 0), ("c", 1), ("b", 2), ("d", 3)], "model string, position int")
    assert ev.pick_best(m, pos).first()["model"] == "c"
    assert ev.pick_best(m.where("RMSE >= 1000"), pos).count() == 0
    trials = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 2.0), (3, 2.0), (4, None), (5, 0.0), (6, -1.0)], "trial bigint, rmse double")
    got = [(r["trial"], r["improvement_pct"]) for r in ev.champion_trace(trials).orderBy("trial").collect()]
    assert got == [(0, None), (2, 50.0), (3, 0.0), (5, 100.0), (6, float("inf"))]


def test_patience():
    assert md.rounds_until_stop([5, 4, 3, 3.5, 3.6, 1], 2) == 3
    assert md.rounds_until_stop([5, 4, 3, 3.5, 1], 2) == 5
    assert md.rounds_until_stop([1], 5) == 1


def test_search_records_failures(spark):
    from demandspark.config import SearchSpace

    calls = []

    def objective(p):
        calls.append(p)
        if len(calls) == 1:
            raise RuntimeError("bad point")
        return p["x"]

    space = SearchSpace(4, floats={"x": (0.0, 1.0)}, log_floats={"y": (1e-6, 1.0)}, choices={"z": (None, "a")})
    best, trials = md.search(spark, space, objective, 1)
    rows = trials.orderBy("trial").collect()
    assert [r["state"] for r in rows] == ["FAIL", "COMPLETE", "COMPLETE", "COMPLETE"]
    assert best["x"] == min(r["rmse"] for r in rows if r["rmse"] is not None)
    assert all(1e-6 <= p["y"] <= 1.0 for p in calls)


def test_no_range_of_a_hot_group_is_larger_than_its_limit(spark):
    # One group has a third of all rows, each another value.
    df = spark.range(9_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) as g", "cast(id as double) as v", "1 as w")
    counts = q.value_counts(df, ["v", "w"], "double", ["g"])
    sizes = [r["count"] for r in q.ranged(counts, ["g"], 500).groupBy("g", "column", "part").count().collect()]
    assert max(sizes) < 1_000 and sum(sizes) == counts.count()
    got = {(r.g, r.column): (r.m, r.p) for r in q.grouped_quantiles(df, ["v", "w"], {"m": 0.5, "p": 0.9}, ["g"], max_rows=500).collect()}
    assert got["hot", "v"] == (4498.5, pytest.approx(8097.3)) and got["hot", "w"] == (1.0, 1.0)


def test_column_facts_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.gamma(2.0, 3.0, 400), rng.integers(0, 5, 400).astype(float)
    df = spark.createDataFrame([(float(x), None if y == 4 else float(y), 7.0) for x, y in zip(a, b)], "a double, b double, c double").repartition(3)
    facts = pf.column_facts(pf.numeric_counts(df, df.columns), {**pf.MEDIAN, "q1": (0.25, "nearest")})
    for c, x in (("a", a), ("b", b[b < 4])):
        f, d = facts[c], x - x.mean()
        assert (f.rows, f.count, f.low, f.high) == (400, len(x), x.min(), x.max())
        assert f.mean == pytest.approx(x.mean()) and f.variance == pytest.approx(x.var(ddof=1)) and f.quantiles["median"] == pytest.approx(np.median(x))
        assert f.skewness == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and f.kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
        assert f.quantiles["q1"] == np.sort(x)[int(0.25 * (len(x) - 1) + 0.5)]
    assert facts["b"].unique == 5 and facts["c"].variance == 0 and facts["c"].skewness is None
    one = pf.column_facts(pf.numeric_counts(df.limit(1), ["c"]), pf.MEDIAN)["c"]
    assert one.variance is None and one.std is None and one.quantiles["median"] == 7.0


def test_correlations_of_many_columns_against_numpy(spark):
    import numpy as np

    k = 2 * ex.GRAM_BLOCK + 3
    x = np.random.default_rng(5).normal(size=(300, k)) @ np.random.default_rng(6).normal(size=(k, k)) + 1e7
    rows = [(*map(float, r), 3.0, None if i == 9 else float(i)) for i, r in enumerate(x)]
    names = [f"v{i}" for i in range(k)] + ["flat", "gap"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {(r.a, r.b): r.r for r in ex.pearson_matrix(df).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == (k + 2) ** 2
    for i in range(k):
        for j in range(k):
            assert got[f"v{i}", f"v{j}"] == pytest.approx(want[i, j], abs=1e-6)
        assert got[f"v{i}", "flat"] is None and got["gap", f"v{i}"] is None


@pytest.mark.parametrize("limit", [200_000, 20, 3])
def test_split_positions_by_selection(spark, monkeypatch, limit):
    import datetime

    monkeypatch.setattr(sp, "SORTED_ROWS", limit)
    rnd = random.Random(3)
    start = datetime.datetime(2020, 1, 1)
    rows = [(rnd.choice([None, float("nan"), *map(float, range(5))]), rnd.randrange(3), i, start + datetime.timedelta(hours=rnd.randrange(40)), rnd.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b int, id int, t timestamp, s string").repartition(5).cache()
    n = len(rows)
    for order in (("a", "b", "id"), ("t", "id"), ("s", "a", "id"), ("b", "a", "t", "id")):
        want = [r.id for r in df.orderBy(*order).collect()]
        got = {r.id: r.split for r in sp.label_split(df, SeriesSpec(order), 0.2, 0.3).collect()}
        train, val = sp.split_sizes(n, 0.2, 0.3)
        assert [got[i] for i in want] == ["train"] * (train + 1) + ["val"] * val + ["test"] * (n - train - 1 - val)
        two = {r.id: r.split for r in sp.label_two_way(df, SeriesSpec(order), 0.37).collect()}
        k = int((1 - 0.37) * n)
        assert [two[i] for i in want] == ["train"] * k + ["test"] * (n - k)


def test_splits_count_rows_when_ties_span_a_bound(spark):
    # Rows equal in every order column are one tie; SQL's row_number still cuts through it.
    rows = [(i, i // 4 if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t long")
    spec = SeriesSpec(("t",))
    two = [r.split for r in sp.label_two_way(df, spec, 0.75).collect()]
    assert (two.count("train"), two.count("test")) == (10, 30)
    n_train, n_val = sp.split_sizes(40, 0.3, 0.3)
    three = [r.split for r in sp.label_split(df, spec, 0.3, 0.3).collect()]
    assert (three.count("train"), three.count("val")) == (n_train + 1, n_val)
    assert "__tie" not in sp.label_two_way(df, spec, 0.75).columns
