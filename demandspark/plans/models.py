"""Training, cross-validation, search and evaluation with Spark's distributed trees.

Feature tables are written once to the checkpoint folder before the model loop; only
metric rows and per-round errors reach the driver.
"""

from __future__ import annotations

import math
import random
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark import SparkContext, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.config import (
    BOOST_A_SPACE,
    BOOST_B_SPACE,
    FOREST_SPACE,
    BoostConfig,
    FeatureConfig,
    ForestConfig,
    SearchSpace,
    TrainConfig,
)
from demandspark.operators import evaluate as ev
from demandspark.operators import profile as prof
from demandspark.operators import split as sp
from demandspark.operators.ordered import SeriesSpec
from demandspark.plans.features import build_features
from demandspark.session import checkpoint_dir, materialize, scratch_path

FOREST, BOOSTED_A, BOOSTED_B = "RandomForestRegressor", "BoostedTreesA", "BoostedTreesB"
FEATURES = "features"
MAX_BINS = 64
PART_ROWS = 50_000
INDEX = "__row"


@dataclass
class TrainResult:
    """One trained model: metrics on its validation rows and what it was built with."""

    model_name: str
    model: object
    metrics: dict[str, float | None]
    params: dict[str, object] = field(default_factory=dict)
    rounds: int | None = None


def assemble(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Feature vector + target; every column but target and keys is a feature."""
    cols = [c for c in df.columns if c != target and c not in keys]
    out = VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep").transform(df)
    return out.select(*keys, FEATURES, F.col(target).cast("double").alias(target))


def demand_model(features: DataFrame, regressor, target: str = "target", keys: Sequence[str] = ()) -> PipelineModel:
    """Assembler and regressor fitted as one pipeline, to score plain feature tables."""
    names = feature_names(features, target, keys)
    vector = VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep")
    return Pipeline(stages=[vector, regressor]).fit(features)


def feature_names(df: DataFrame, target: str, keys: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != target and c not in keys]


# -- estimators -------------------------------------------------------------------------


def forest(cfg: ForestConfig, seed: int, target: str = "target") -> RandomForestRegressor:
    """Random forest. ``min_samples_split`` has no counterpart; the leaf size has."""
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=target,
        numTrees=cfg.n_estimators,
        maxDepth=cfg.max_depth,
        minInstancesPerNode=cfg.min_samples_leaf,
        featureSubsetStrategy=cfg.max_features or "all",
        bootstrap=cfg.bootstrap,
        subsamplingRate=1.0,
        maxBins=MAX_BINS,
        seed=seed,
    )


def rounds_until_stop(errors: Sequence[float], patience: int) -> int:
    """Best round (1-based) seen before ``patience`` rounds pass without a gain."""
    best, best_round = math.inf, 0
    for i, e in enumerate(errors, start=1):
        if e < best:
            best, best_round = e, i
        elif i - best_round >= patience:
            break
    return max(best_round, 1)


def fit_boosted(train: DataFrame, val: DataFrame, cfg: BoostConfig, seed: int, target: str = "target"):
    """Boosted trees stopped by patience: (model, rounds used).

    Spark's own validation stop is tolerance-based, so the patience rule is applied to the
    per-round validation errors of a fit. With a fixed seed a short fit is the prefix of a
    long one, so fits start short and double until the rule stops one or all rounds are
    used; what is returned is made of the trees up to the best round.
    """
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))

    def gbt(rounds: int) -> GBTRegressor:
        return GBTRegressor(
            featuresCol=FEATURES,
            labelCol=target,
            maxIter=rounds,
            stepSize=cfg.learning_rate,
            maxDepth=cfg.max_depth,
            subsamplingRate=cfg.subsample,
            minInstancesPerNode=cfg.min_child_weight,
            minInfoGain=cfg.min_gain,
            maxBins=MAX_BINS,
            seed=seed,
        )

    tried = min(cfg.num_boost_round, cfg.early_stopping_rounds + 5)
    while True:
        model = gbt(tried).fit(train)
        rounds = rounds_until_stop(model.evaluateEachIteration(val, "squared"), cfg.early_stopping_rounds)
        if rounds + cfg.early_stopping_rounds <= tried or tried == cfg.num_boost_round:
            break
        tried = min(cfg.num_boost_round, 2 * tried)
    return (model if rounds == tried else first_rounds(model, rounds)), rounds


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model that a fit of so many rounds gives: the first trees of a longer one and their weights."""
    gateway, jvm = SparkContext._active_spark_context._gateway, SparkContext._active_spark_context._jvm
    ml = jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(ml.DecisionTreeRegressionModel, rounds), gateway.new_array(jvm.double, rounds)
    for i, tree in enumerate(list(model._java_obj.trees())[:rounds]):
        trees[i], weights[i] = tree, float(model.treeWeights[i])
    out = GBTRegressionModel(ml.GBTRegressionModel(f"{model.uid}_{rounds}", trees, weights, model.numFeatures))
    out._resetUid(f"{model.uid}_{rounds}")
    return model._copyValues(out)


def predictions(model, df: DataFrame, target: str, keys: Sequence[str], name: str) -> DataFrame:
    """(model, keys..., y, yhat)."""
    return model.transform(df).select(
        F.lit(name).alias("model"), *keys, F.col(target).alias("y"), F.col("prediction").alias("yhat")
    )


def _metrics(pred: DataFrame, n_features: int | None) -> dict[str, float | None]:
    row = ev.regression_metrics(pred, n_features=n_features).first()
    return row.asDict() if row else dict.fromkeys(ev.METRICS)


# -- cross-validation --------------------------------------------------------------------


def cross_validate(
    df: DataFrame,
    fit: Callable[[DataFrame], object],
    n_splits: int,
    test_size: int,
    target: str = "target",
    n_features: int | None = None,
    index: str = INDEX,
) -> tuple[object, dict[str, float | None], DataFrame]:
    """Expanding-window folds over an indexed table.

    Returns the last fold's model, the mean of the rounded fold metrics, and the fold
    metrics as rows. Folds are range filters on the index; nothing is copied.
    """
    spark = df.sparkSession
    rows, model = [], None
    for fold, start, end in sp.fold_bounds(df.count(), n_splits, test_size):
        model = fit(df.where(F.col(index) < start))
        test = df.where((F.col(index) >= start) & (F.col(index) < end))
        m = _metrics(predictions(model, test, target, [], "cv"), n_features)
        rows.append(("cv", fold, *[m[k] for k in ev.METRICS]))
    folds = spark.createDataFrame(
        rows, "model string, fold int, MAE double, RMSE double, MAPE double, Adjusted_R2 double"
    )
    mean = ev.mean_of_folds(folds).first().asDict()
    return model, {k: mean[k] for k in ev.METRICS}, folds


# -- training ------------------------------------------------------------------------------


@dataclass
class Prepared:
    """Assembled, materialised parts; ``both`` is train + val with a row index."""

    train: DataFrame
    val: DataFrame
    test: DataFrame
    both: DataFrame
    features: list[str]
    target: str
    keys: list[str]


def _sized(df: DataFrame) -> DataFrame:
    """As many partitions as rows need: tree fits run a job over all of them for every level."""
    n = max(1, -(-df.count() // PART_ROWS))
    return df.coalesce(n) if n < df.rdd.getNumPartitions() else df


def prepare(
    train: DataFrame, val: DataFrame, test: DataFrame, order: Sequence[str], target: str = "target"
) -> Prepared:
    """Vectors for three feature tables that still carry their order columns."""
    keys = list(order)
    names = feature_names(train, target, keys)
    parts = [_sized(materialize(assemble(p.select(*train.columns), target, keys))) for p in (train, val, test)]
    both = sp.combine_rows(parts[0], parts[1])
    indexed = _sized(materialize(sp.add_row_index(both, SeriesSpec(tuple(order)), INDEX)))
    return Prepared(*parts, indexed, names, target, keys)


def train_forest(data: Prepared, cfg: TrainConfig) -> TrainResult:
    model, metrics, _ = cross_validate(
        data.both,
        lambda t: forest(cfg.forest, cfg.random_seed, data.target).fit(t),
        cfg.n_splits,
        cfg.cv_test_size,
        data.target,
        len(data.features),
    )
    return TrainResult(FOREST, model, metrics, asdict(cfg.forest))


def train_boosted(data: Prepared, boost: BoostConfig, cfg: TrainConfig, name: str) -> TrainResult:
    model, rounds = fit_boosted(data.train, data.val, boost, cfg.random_seed, data.target)
    metrics = _metrics(predictions(model, data.val, data.target, [], name), len(data.features))
    return TrainResult(name, model, metrics, asdict(boost), rounds)


def train_all(data: Prepared, cfg: TrainConfig) -> tuple[list[TrainResult], DataFrame]:
    """All three models, and their test predictions as (model, keys..., y, yhat)."""
    results = [
        train_forest(data, cfg),
        train_boosted(data, cfg.boost_a, cfg, BOOSTED_A),
        train_boosted(data, cfg.boost_b, cfg, BOOSTED_B),
    ]
    return results, _test_predictions(data, results)


def _test_predictions(data: Prepared, results: Sequence[TrainResult]) -> DataFrame:
    parts = [predictions(r.model, data.test, data.target, data.keys, r.model_name) for r in results]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(result: TrainResult, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """(model, feature, importance) of a trained model."""
    values = result.model.featureImportances.toArray()
    rows = [(result.model_name, n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


# -- search --------------------------------------------------------------------------------


def draw(space: SearchSpace, rng: random.Random) -> dict[str, object]:
    """One random point of a search space."""
    p: dict[str, object] = {k: rng.choice(v) for k, v in space.choices.items()}
    p.update({k: rng.randint(lo, hi) for k, (lo, hi) in space.ints.items()})
    p.update({k: rng.uniform(lo, hi) for k, (lo, hi) in space.floats.items()})
    p.update(
        {k: math.exp(rng.uniform(math.log(lo), math.log(hi))) for k, (lo, hi) in space.log_floats.items()}
    )
    return p


TRIALS_SCHEMA = "model string, trial bigint, params map<string,string>, rmse double, state string, seconds double"


class TrialLog:
    """Finished trials of a search, as a table that each of them is added to when it ends.

    A search that is started again reads it and runs only what is missing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path, threading.Lock()

    def read(self) -> DataFrame:
        """One row for each trial; the first kept of a trial that was written twice."""
        try:
            rows = self.spark.read.schema(TRIALS_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TRIALS_SCHEMA)
        return rows.dropDuplicates(["model", "trial"])

    def add(self, row: tuple) -> None:
        with self._lock:  # one row at a time, as a file of its own
            self.spark.createDataFrame([row], TRIALS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def search(
    spark: SparkSession,
    space: SearchSpace,
    objective: Callable[[dict], float],
    seed: int,
    name: str = "model",
    log: TrialLog | None = None,
    at_once: int = 1,
) -> tuple[dict[str, object], DataFrame]:
    """Seeded random search: best parameters and (model, trial, params, rmse, state, seconds) rows.

    All points are drawn first, so they depend neither on the order in which trials end nor on a
    restart. Up to ``at_once`` trials run side by side, each in a scheduler pool of its own. A
    failing trial is recorded with state FAIL and does not stop the search.
    """
    rng = random.Random(seed)
    points = [draw(space, rng) for _ in range(space.n_trials)]
    log = log or TrialLog(spark, scratch_path(spark, "trials"))
    known = {r["trial"] for r in log.read().where(F.col("model") == name).select("trial").collect()}

    def run(trial: int) -> None:
        params, began = points[trial], time.monotonic()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial % at_once}")
        try:
            rmse, state = objective(params), "COMPLETE"
        except Exception as e:  # recorded, as one bad point must not end the search
            rmse, state = None, "FAIL"
            params = {**params, "error": str(e)}
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        log.add((name, trial, {k: str(v) for k, v in params.items()}, rmse, state, time.monotonic() - began))

    missing = [t for t in range(space.n_trials) if t not in known]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        # Wrapped one by one: each trial has its own copy of this thread's settings.
        for done in [pool.submit(inheritable_thread_target(spark)(run), t) for t in missing]:
            done.result()
    trials = log.read().where((F.col("model") == name) & (F.col("trial") < space.n_trials))
    best = trials.where(F.col("rmse").isNotNull()).orderBy("rmse", "trial").first()
    if best is None:
        raise ValueError("every trial failed")
    return points[best["trial"]], trials


def tune(
    data: Prepared, cfg: TrainConfig, spaces: dict[str, SearchSpace] | None = None, path: str | None = None, at_once: int | None = None
) -> tuple[list[TrainResult], DataFrame, DataFrame]:
    """Search every model, refit the best: results, test predictions, trials of all.

    The parts are assembled once and cached while the trials run. Trials are kept at ``path``, where
    a search that broke off goes on. ``at_once`` trials run side by side, by default as many as
    the cluster has tasks for tables of one partition, at most eight.
    """
    spark = data.train.sparkSession
    spaces = spaces or {FOREST: FOREST_SPACE, BOOSTED_A: BOOST_A_SPACE, BOOSTED_B: BOOST_B_SPACE}
    log = TrialLog(spark, path or scratch_path(spark, "trials"))
    at_once = at_once or max(1, min(8, spark.sparkContext.defaultParallelism // max(1, data.both.rdd.getNumPartitions())))
    cached = [p.persist() for p in (data.train, data.val, data.both)]
    results, trial_parts = [], []
    for name, space in spaces.items():
        if name == FOREST:
            run = lambda p: train_forest(data, replace(cfg, forest=replace(cfg.forest, **p)))
        else:
            base = cfg.boost_a if name == BOOSTED_A else cfg.boost_b
            run = lambda p, base=base, name=name: train_boosted(data, replace(base, **p), cfg, name)
        best, trials = search(spark, space, lambda p, run=run: run(p).metrics["RMSE"], cfg.random_seed, name, log, at_once)
        results.append(run(best))
        trial_parts.append(trials)
    for p in cached:
        p.unpersist()
    out = trial_parts[0]
    for t in trial_parts[1:]:
        out = out.unionByName(t)
    return results, _test_predictions(data, results), out


# -- runs ------------------------------------------------------------------------------------


RUNS_SCHEMA = "run_id string, model string, params map<string,string>, metrics map<string,double>, tags map<string,string>"


def run_rows(spark: SparkSession, results: Sequence[TrainResult], run_id: str, tags: dict[str, str] | None = None) -> DataFrame:
    """One row per model: run id, parameters, metrics, tags."""
    rows = [
        (
            f"{run_id}-{i}",
            r.model_name,
            {k: str(v) for k, v in {**r.params, "rounds": r.rounds}.items() if v is not None},
            {k: v for k, v in r.metrics.items() if v is not None},
            {**(tags or {}), "model_family": r.model_name},
        )
        for i, r in enumerate(results)
    ]
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def log_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the runs table; runs of the same id are replaced, so logging again changes nothing."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(path)


# -- whole job -------------------------------------------------------------------------------


@dataclass
class JobResult:
    profile: DataFrame
    results: list[TrainResult]
    predictions: DataFrame
    metrics: DataFrame
    best: DataFrame
    trials: DataFrame | None = None


def build_parts(
    df: DataFrame, spec: SeriesSpec, cfg: TrainConfig, features: FeatureConfig | None = None, fit: str = "self"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split in time, then features per part.

    ``fit="self"`` takes percentile thresholds from each part; ``"train"`` from the train
    part only.
    """
    from demandspark.plans.features import fit_thresholds

    if fit not in ("self", "train"):
        raise ValueError("fit must be 'self' or 'train'")
    parts = sp.split_train_val_test(df, spec, cfg.test_size, cfg.val_size)
    shared = fit_thresholds(parts[0]) if fit == "train" else None
    return tuple(build_features(p, spec, features, shared, keep=spec.order_by) for p in parts)


def run_job(
    df: DataFrame,
    spec: SeriesSpec,
    cfg: TrainConfig | None = None,
    features: FeatureConfig | None = None,
    spaces: dict[str, SearchSpace] | None = None,
    tuning: bool = False,
    fit: str = "self",
    trials_path: str | None = None,
) -> JobResult:
    """Profile, split, build features, train or tune, evaluate on test, pick the best.

    ``fit`` is that of :func:`build_parts`; trials of a search are kept at ``trials_path``.
    """
    cfg = cfg or TrainConfig()
    spark = df.sparkSession
    # Profile and split read the rows several times; what they come from is computed once.
    df = materialize(df)
    profile = prof.profile(df)
    train, val, test = build_parts(df, spec, cfg, features, fit)
    data = prepare(train, val, test, spec.order_by, cfg.target_col)
    trials = None
    if tuning:
        results, pred, trials = tune(data, cfg, spaces, trials_path)
    else:
        results, pred = train_all(data, cfg)
    metrics = ev.regression_metrics(pred, by=["model"])
    positions = spark.createDataFrame(
        [(r.model_name, i) for i, r in enumerate(results)], "model string, position int"
    )
    return JobResult(profile, results, pred, metrics, ev.pick_best(metrics, positions), trials)
