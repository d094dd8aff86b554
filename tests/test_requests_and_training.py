from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from demandspark.config import BoostConfig
from demandspark.operators import evaluate as ev
from demandspark.operators import split as sp
from demandspark.operators.ordered import SeriesSpec
from demandspark.plans import models as md
from demandspark.plans import requests as rq
from demandspark.session import checkpoint_dir
from demandspark.sources import io

RECORD = dict(
    datetime="2011-01-01 05:00:00", season=1, yr=0, mnth=1, hr=5, holiday=0, weekday=6, workingday=0,
    weathersit=1, temp=0.257, hum=0.5, windspeed=0.1, cnt=3,
)


def _labels(spark, rows, kind):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"id int, t {kind}").repartition(3)
    spec = SeriesSpec(("t", "id"))
    want = [r.id for r in df.orderBy("t", "id").collect()]
    three = {r.id: r.split for r in sp.label_split(df, spec, 0.2, 0.2).collect()}
    two = {r.id: r.split for r in sp.label_two_way(df, spec, 0.8).collect()}
    return [three[i] for i in want], [two[i] for i in want]


@pytest.mark.parametrize(
    ("rows", "kind"),
    [
        ([None] * 3 + [float(i) for i in range(7)], "double"),
        ([None] * 7 + [1.0, 2.0, 3.0], "double"),
        ([float("nan")] * 4 + [1.0, 2.0, None, None, 3.0, 4.0], "double"),
        ([None, "b", "a", "c", None, "d", "e", "f", "g", "h"], "string"),
    ],
)
def test_splits_follow_the_series_order(spark, rows, kind):
    three, two = _labels(spark, rows, kind)
    assert three == ["train"] * 7 + ["val"] * 2 + ["test"]
    assert two == ["train"] + ["test"] * 9 or two == ["train"] * 2 + ["test"] * 8


def test_single_order_column_with_nulls(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "t int")
    for test_size, train in ((0.75, [None]), (0.5, [None, 1]), (0.0, [None, 1, 2, 3, 4])):
        got = sp.label_two_way(df, SeriesSpec(("t",)), test_size).collect()
        assert sorted((r.t for r in got if r.split == "train"), key=lambda t: t or 0) == train


def test_mean_of_an_even_number_of_folds_rounds_the_product(spark):
    rows = [("m", 2.67, 1.0, 1.0, 1.0), ("m", 2.68, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, MAE double, RMSE double, MAPE double, Adjusted_R2 double")
    assert ev.mean_of_folds(df).first()["MAE"] == 2.68


def _vectors(spark, n, part):
    rows = [(i, Vectors.dense([float(i % 7), float(i % 3)]), float(2 * (i % 7) - i % 3)) for i in range(part, n, 2)]
    return spark.createDataFrame(rows, ["index", "features", "target"])


def test_a_shorter_boosted_fit_is_the_prefix_of_a_long_one(spark):
    train, val = _vectors(spark, 80, 0), _vectors(spark, 80, 1)
    cfg = BoostConfig(num_boost_round=6, early_stopping_rounds=6, max_depth=2)
    long, rounds = md.fit_boosted(train, val, cfg, 1)
    assert 1 <= rounds <= 6
    again, same = md.fit_boosted(train, val, BoostConfig(num_boost_round=6, early_stopping_rounds=1, max_depth=2), 1)
    assert same == md.rounds_until_stop(md.GBTRegressor(featuresCol="features", labelCol="target", maxIter=6, maxDepth=2, maxBins=md.MAX_BINS, seed=1).fit(train).evaluateEachIteration(val, "squared"), 1)
    short, _ = md.fit_boosted(train, val, BoostConfig(num_boost_round=3, early_stopping_rounds=6, max_depth=2), 1)
    for a, b in zip(short.trees, long.trees):
        assert a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1]


def test_cross_validation_uses_the_last_folds_model(spark):
    df = _vectors(spark, 40, 0).withColumn(md.INDEX, (F.col("index") / 2).cast("long"))
    sizes = []

    def fit(part):
        sizes.append(part.count())
        return md.forest(md.ForestConfig(n_estimators=2, max_depth=2), 1).fit(part)

    model, mean, folds = md.cross_validate(df, fit, 3, 4, n_features=2)
    assert sizes == [8, 12, 16] and folds.count() == 3 and set(mean) == set(ev.METRICS)
    assert model.getNumTrees == 2


def test_requests_are_checked(spark, tmp_path):
    bad_time, bad_hour = {**RECORD, "datetime": "yesterday"}, {**RECORD, "hr": 24}
    rows = [{"data": [RECORD, bad_time], "currency": None}, {"data": [bad_hour], "currency": "EUR"}]
    io.from_records(spark, rows, io.REQUEST_SCHEMA).write.json(f"{tmp_path}/in")
    ok, rejected = rq.checked_requests(io.read_records(spark, f"{tmp_path}/in", io.REQUEST_SCHEMA))
    assert [(r.currency, r.temp) for r in ok.collect()] == [("NGN", 0.26)]
    assert sorted(r.violations for r in rejected.collect()) == [["datetime"], ["hr", "currency"]]


def test_failed_trials_keep_the_whole_error(spark):
    space = md.SearchSpace(n_trials=2, ints={"a": (1, 3)})

    def objective(p, done=[]):
        done.append(p)
        if len(done) == 1:
            raise RuntimeError("x" * 1000)
        return 1.0

    trials = md.search(spark, space, objective, 1)[1].orderBy("trial").collect()
    assert [t.state for t in trials] == ["FAIL", "COMPLETE"] and "x" * 1000 in trials[0].params["error"]


def test_a_search_goes_on_where_it_broke_off(spark, tmp_path):
    space = md.SearchSpace(n_trials=6, ints={"a": (1, 1000)})
    log = md.TrialLog(spark, f"{tmp_path}/trials")
    first, pools = [], set()

    def objective(p):
        first.append(p["a"])
        pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return float(spark.range(p["a"]).count())

    md.search(spark, space.with_trials(4), objective, 7, "m", log, at_once=2)
    again = []
    best, trials = md.search(spark, space, lambda p: again.append(p["a"]) or float(p["a"]), 7, "m", log, at_once=3)
    rows = trials.orderBy("trial").collect()
    assert len(first) == 4 and len(again) == 2 and pools == {"trial-0", "trial-1"}
    assert [r.trial for r in rows] == list(range(6)) and all(r.state == "COMPLETE" and r.seconds >= 0 for r in rows)
    assert [float(r.params["a"]) for r in rows] == [r.rmse for r in rows] and best["a"] == min(r.rmse for r in rows)
    # The same points whatever ran before.
    assert md.search(spark, space, lambda p: float(p["a"]), 7)[0] == best
    assert md.search(spark, space, objective, 7, "other", log)[1].count() == 6 and log.read().count() == 12


def test_the_first_rounds_of_a_fit_are_the_shorter_fit(spark):
    train, val = _vectors(spark, 80, 0), _vectors(spark, 80, 1)
    gbt = lambda n: md.GBTRegressor(featuresCol="features", labelCol="target", maxIter=n, maxDepth=2, stepSize=0.3, seed=3).fit(train)
    cut, short = md.first_rounds(gbt(6), 2), gbt(2)
    both = [[r.prediction for r in m.transform(val).orderBy("index").collect()] for m in (cut, short)]
    assert both[0] == both[1] and cut.getNumTrees == 2 and cut.numFeatures == short.numFeatures
    assert cut.featureImportances == short.featureImportances


def test_logging_a_run_twice_keeps_one_row(spark, tmp_path):
    result = md.TrainResult("m", None, {"RMSE": 1.0, "MAE": None}, {"depth": 3})
    for run, tag in (("a", "x"), ("b", "x"), ("a", "y")):
        md.log_runs(md.run_rows(spark, [result, result], run, {"tag": tag}), f"{tmp_path}/runs")
    rows = sorted(md.read_runs(spark, f"{tmp_path}/runs").collect(), key=lambda r: r.run_id)
    assert [(r.run_id, r.tags["tag"]) for r in rows] == [("a-0", "y"), ("a-1", "y"), ("b-0", "x"), ("b-1", "x")]
    assert rows[0].params == {"depth": "3"} and rows[0].metrics == {"RMSE": 1.0}


def _hours(spark, n):
    from demandspark.catalog.base import hourly

    return hourly(spark, "/root/testdata/sf0.01").orderBy("datetime").limit(n)


def test_thresholds_of_the_train_part(spark):
    from demandspark.plans.features import fit_thresholds

    df, spec, cfg = _hours(spark, 200), SeriesSpec(("datetime",)), md.TrainConfig()
    train, val, test = md.build_parts(df, spec, cfg, fit="train")
    own = md.build_parts(df, spec, cfg)
    shared = fit_thresholds(sp.split_train_val_test(df, spec, cfg.test_size, cfg.val_size)[0])
    assert train.columns == own[2].columns and test.count() == own[2].count()
    flags = [r for r in sp.split_train_val_test(df, spec, cfg.test_size, cfg.val_size)[2].orderBy("datetime").collect()]
    got = [r.is_high_temp for r in test.orderBy("datetime").collect()]
    assert got == [int(r.temp > shared.temp) for r in flags]
    with pytest.raises(ValueError):
        md.build_parts(df, spec, cfg, fit="test")


def test_job_with_tuning(spark, tmp_path):
    spaces = {
        md.FOREST: md.SearchSpace(2, ints={"n_estimators": (2, 3), "max_depth": (2, 3)}),
        md.BOOSTED_A: md.SearchSpace(2, ints={"num_boost_round": (2, 4), "max_depth": (2, 3), "early_stopping_rounds": (1, 2)}),
    }
    cfg = md.TrainConfig(n_splits=2, cv_test_size=12)
    job = md.run_job(_hours(spark, 300), SeriesSpec(("datetime",)), cfg, spaces=spaces, tuning=True, fit="train", trials_path=f"{tmp_path}/trials")
    trials = job.trials.collect()
    assert sorted((t.model, t.trial) for t in trials) == sorted((m, i) for m in spaces for i in (0, 1)) and all(t.state == "COMPLETE" for t in trials)
    assert [r.metrics["RMSE"] for r in job.results] == [min(t.rmse for t in trials if t.model == m) for m in spaces]
    assert job.best.first()["model"] in spaces and job.predictions.select("model").distinct().count() == 2


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
