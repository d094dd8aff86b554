"""Metrics, model selection, run and trial tables, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.functions.numeric import percent_change, round2, round_half_up, round_product
from demandspark.operators.ordered import OrderedFrame, SeriesSpec, lag

METRICS = ["MAE", "RMSE", "MAPE", "Adjusted_R2"]
START_SCORE = 1000.0  # a model must be below this to be chosen
ZERO_ACTUAL = 0.01  # stands for an actual of 0 in MAPE
NEAR_ZERO = 1e-10


def regression_metrics(
    df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = (), n_features: int | None = None
) -> DataFrame:
    """MAE, RMSE, MAPE (percent) and adjusted R2 at 2 dp, per group, in one aggregate.

    Adjusted R2 is null without ``n_features``, and where it is undefined.
    """
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    err = a - p
    denom = F.when(a == 0, F.lit(ZERO_ACTUAL)).otherwise(a)
    agg = df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err / denom)).alias("mape"),
        F.var_pop(a).alias("var_y"),
        F.count(err).alias("n"),
    )
    if n_features:
        r2 = F.lit(1.0) - F.try_divide("mse", "var_y")
        adj = round2(F.lit(1.0) - (F.lit(1.0) - r2) * F.try_divide(F.col("n") - 1, F.col("n") - n_features - 1))
    else:
        adj = F.lit(None).cast("double")
    return agg.where(F.col("n") > 0).select(
        *by,
        round2(F.col("mae")).alias("MAE"),
        round2(F.sqrt("mse")).alias("RMSE"),
        round2(F.col("mape") * F.lit(100.0)).alias("MAPE"),
        adj.alias("Adjusted_R2"),
    )


def mean_of_folds(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of the (already rounded) fold metrics, 2 dp by the rule of array libraries."""
    return metrics.groupBy(*by).agg(*[round_product(F.avg(m)).alias(m) for m in METRICS])


def evaluate_models(predictions: DataFrame, truth: DataFrame, key: str = "row_key") -> DataFrame:
    """Metrics per model: predictions (model, key, yhat) joined to truth (key, y).

    A model without predictions has no row.
    """
    return regression_metrics(predictions.select("model", key, "yhat").join(truth.select(key, "y"), key), by=["model"])


def pick_best(metrics: DataFrame, positions: DataFrame) -> DataFrame:
    """(model, RMSE) with the lowest RMSE below 1000; ties go to the first listed model.

    ``positions`` holds (model, position), a row per model.
    """
    ranked = metrics.join(positions, "model").where(F.col("RMSE") < START_SCORE)
    best = ranked.agg(F.min(F.struct("RMSE", "position", "model")).alias("b"))
    return best.where(F.col("b").isNotNull()).select("b.model", "b.RMSE")


def best_run(runs: DataFrame, metric: str = "RMSE") -> DataFrame:
    """(run_id, metric_value) of the run with the lowest metric; ties by run id."""
    value = F.col("metrics")[metric]
    best = runs.where(value.isNotNull()).agg(F.min(F.struct(value.alias("v"), F.col("run_id"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select("b.run_id", F.col("b.v").alias("metric_value"))


def champion_trace(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trials that set a new best, with the improvement in percent over the best before."""
    spec = SeriesSpec(("trial",), tuple(by))
    scored = OrderedFrame(trials.where(F.col("rmse").isNotNull()), spec)
    out = scored.running_min("rmse", "__best").with_ops([lag("__best", 1, "previous_best")]).df
    before = F.col("previous_best")
    gain = before - F.col("rmse")
    improvement = (
        F.when(before.isNull(), F.lit(None).cast("double"))
        .when(F.abs(before) < NEAR_ZERO, F.when(gain != 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        .otherwise(F.try_divide(gain, F.abs(before)) * F.lit(100.0))
    )
    return out.where(before.isNull() | (gain >= 0)).select(
        *by, "trial", "rmse", "previous_best", improvement.alias("improvement_pct")
    )


def top_importances(df: DataFrame, n: int = 20, by: Sequence[str] = ("model",)) -> DataFrame:
    """Top ``n`` features per model with rank and text tag ``name (0.1234)``; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return (
        df.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .withColumn("tag", F.format_string("%s (%.4f)", "feature", F.col("importance").cast("double")))
    )


def importance_share(scores: DataFrame, features: DataFrame, digits: int | None = 5) -> DataFrame:
    """Share of each feature in the total, features without a score 0.0.

    ``scores`` (feature, importance), ``features`` (feature): a row per model input.
    """
    total = scores.agg(F.sum("importance")).first()[0]
    share = F.col("importance") / F.lit(float(total)) if total else F.lit(None).cast("double")
    share = round_half_up(share, digits) if digits is not None else share
    return features.join(scores, "feature", "left").select(
        "feature", F.coalesce(share, F.lit(0.0)).alias("importance")
    )


def normalised_importances(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Each measure divided by its own sum, as ``<measure>_normalized``."""
    sums = df.agg(*[F.sum(m).cast("double").alias(m) for m in measures]).first()
    return df.withColumns({f"{m}_normalized": F.try_divide(F.col(m).cast("double"), F.lit(sums[m])) for m in measures})


def flatten_metrics(df: DataFrame, col: str = "metrics") -> DataFrame:
    """Lift the fields of a metrics struct to columns; the other columns stay."""
    fields = df.schema[col].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != col], *[F.col(f"{col}.{f}").alias(f) for f in fields])


def prefix_metrics(metrics: Column, prefix: str) -> Column:
    """Map of metrics without nulls, names prefixed ``<prefix>_``."""
    kept = F.map_filter(metrics, lambda _, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, _: F.concat(F.lit(f"{prefix}_"), k))


def compare_metric(df: DataFrame, old: str, new: str, name: str = "pct_change") -> DataFrame:
    return df.withColumn(name, percent_change(F.col(old), F.col(new)))


def trial_statistics(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of fold RMSE per trial."""
    return folds.groupBy("trial").agg(F.avg("rmse").alias("cv_mean"), F.stddev_pop("rmse").alias("cv_std"))


def trial_states(trials: DataFrame) -> DataFrame:
    """(state, trials, share_pct): counts by state and their share, 1 dp."""
    n = trials.count()
    return trials.groupBy("state").agg(F.count(F.lit(1)).alias("trials")).withColumn(
        "share_pct", round_half_up(F.col("trials") / F.lit(float(max(n, 1))) * F.lit(100.0), 1)
    )
