"""Demand scoring: features for a table, model prediction, whole non-negative demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.config import FeatureConfig
from demandspark.operators.ordered import SeriesSpec
from demandspark.plans.features import TARGET, Thresholds, build_features
from demandspark.plans.pricing import whole_demand

# Columns of the training table that a request does not carry.
MISSING_INPUTS = {"atemp": 0.0, "casual": 0.0, "registered": 0.0}


def add_missing_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in MISSING_INPUTS.items()})


def score_demand(
    model,
    df: DataFrame,
    spec: SeriesSpec,
    config: FeatureConfig | None = None,
    thresholds: Thresholds | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Keep columns + ``demand``; history rows in ``df`` give the lags their values."""
    feats = build_features(add_missing_inputs(df), spec, config, thresholds, keep=keep).drop(TARGET)
    scored = model.transform(feats)
    return scored.select(*keep, whole_demand(F.col("prediction")).alias("demand"))
