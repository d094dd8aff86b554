"""Feature building over an ordered series.

Stages: bounded-reach windows (one shuffle, one window node) -> row-local columns ->
target fill -> backward fill -> row-local flags. All window stages partition by the same
keys, so later stages only re-sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.config import FeatureConfig
from demandspark.functions import calendar as cal
from demandspark.functions import numeric as num
from demandspark.operators import ordered as o
from demandspark.operators.ordered import OrderedFrame, SeriesSpec
from demandspark.operators.quantiles import exact_quantiles

# Days and hours behind the flags.
WEEKEND_DAYS = [5, 6]
PEAK_HOURS = [7, 8, 9, 16, 17, 18]
WORKING_HOURS = [9, 10, 11, 12, 13, 14, 15, 16, 17]
BUSINESS_HOURS = [8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]
HIGH_PERCENTILE = 0.8
TARGET = "target"
FILL_STRATEGIES = (None, "forward", "backward", "min", "max", "mean", "zero", "one")


@dataclass(frozen=True)
class Thresholds:
    """80th percentiles that the high-temperature / high-humidity flags compare with."""

    temp: float | None
    hum: float | None


def fit_thresholds(df: DataFrame) -> Thresholds:
    q = exact_quantiles(df, ["temp", "hum"], [HIGH_PERCENTILE])
    return Thresholds(q["temp"][0], q["hum"][0])


def temporal_flag() -> dict[str, Column]:
    return {"is_weekend": num.membership_flag(F.col("weekday"), WEEKEND_DAYS)}


def hour_flags() -> dict[str, Column]:
    return {
        "is_peak_hour": num.membership_flag(F.col("hr"), PEAK_HOURS),
        "is_working_hour": num.membership_flag(F.col("hr"), WORKING_HOURS),
        "is_business_hour": num.membership_flag(F.col("hr"), BUSINESS_HOURS),
    }


def high_flags(t: Thresholds) -> dict[str, Column]:
    return {
        "is_high_temp": num.above_flag(F.col("temp"), F.lit(t.temp).cast("double")),
        "is_high_hum": num.above_flag(F.col("hum"), F.lit(t.hum).cast("double")),
    }


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; an unknown one is an error (Spark's ``drop`` would ignore it)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def target_column(series: OrderedFrame, col: str, name: str = TARGET) -> OrderedFrame:
    """Next row's value; the last row repeats the target before it."""
    return series.with_ops([o.lead(col, 1, name)]).forward_fill([name])


def fill_nulls(
    df: DataFrame, strategy: str | None, spec: SeriesSpec | None = None, cols: Sequence[str] | None = None
) -> DataFrame:
    """Fill ``cols`` (default all) by strategy.

    forward / backward follow the series; statistics and constants apply to the numeric
    columns among ``cols``.
    """
    if strategy not in FILL_STRATEGIES:
        raise ValueError(f"strategy must be one of {FILL_STRATEGIES}")
    if strategy is None:
        return df
    cols = list(df.columns if cols is None else cols)
    if strategy in ("forward", "backward"):
        if spec is None:
            raise ValueError(f"{strategy} fill needs a series")
        cols = [c for c in cols if c not in spec.columns]
        s = OrderedFrame(df, spec)
        return (s.forward_fill(cols) if strategy == "forward" else s.backward_fill(cols)).df
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    if strategy in ("zero", "one"):
        return df.fillna(0 if strategy == "zero" else 1, subset=numeric)
    fn = {"min": F.min, "max": F.max, "mean": F.avg}[strategy]
    row = df.agg(*[fn(c).alias(c) for c in numeric]).first()
    types = {c: "double" if strategy == "mean" else df.schema[c].dataType for c in numeric}
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(row[c]).cast(types[c])) for c in numeric if row[c] is not None}
    )


def _feature_names(cfg: FeatureConfig) -> tuple[list[o.Op], list[o.Op], list[o.Op]]:
    lags = [o.lag(f.feature, k) for f in cfg.lag_features for k in f.lags]
    rolls = [
        op
        for f in cfg.rolling_features
        for w in f.windows
        for op in (o.rolling_mean(f.feature, w), o.rolling_median(f.feature, w))
    ]
    diffs = [o.difference(f.feature, k) for f in cfg.diff_features for k in f.diffs]
    return lags, rolls, diffs


def build_features(
    df: DataFrame,
    spec: SeriesSpec,
    config: FeatureConfig | None = None,
    thresholds: Thresholds | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All features of ``config``; ``keep`` names dropped columns to retain (row keys).

    Thresholds come from ``df`` itself unless given. The backward fill copies later
    values into the first rows of lag, rolling and difference columns; it is part of the
    feature definition.
    """
    cfg = config or FeatureConfig()
    drop = [c for c in cfg.drop_features if c not in keep]
    missing = [c for c in cfg.drop_features if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    t = thresholds or fit_thresholds(df)
    lags, rolls, diffs = _feature_names(cfg)
    inter = [(i.feature_1, i.feature_2, i.operation) for i in cfg.interaction_features]
    inter_cols = {f"{a}_{'plus' if op == 'add' else 'times'}_{b}": num.interaction(a, b, op) for a, b, op in inter}

    flags_first = {**temporal_flag(), **cal.cyclic_columns()}
    flags_last = {**high_flags(t), **hour_flags()}
    ordered_names = [op.name for op in lags + rolls]
    diff_names = [op.name for op in diffs]
    out_cols = [
        *[c for c in df.columns if c not in drop],
        *flags_first,
        *ordered_names,
        *inter_cols,
        *diff_names,
        *flags_last,
        TARGET,
    ]

    series = OrderedFrame(df, spec).with_ops([*lags, *rolls, *diffs, o.lead(cfg.target_col, 1, TARGET)])
    series = series.transform(lambda d: d.withColumns(inter_cols)).forward_fill([TARGET])
    # A row-local flag is null exactly where its source is, so flags are computed from
    # filled sources and need no fill of their own; dropped columns are not filled at all.
    sources = ["weekday", "hr", "temp", "hum"]
    fixed = set(spec.columns)
    fill = [
        c
        for c in dict.fromkeys([*[c for c in df.columns if c not in drop], *sources])
        if c not in fixed and c in df.columns
    ]
    fill += [*ordered_names, *inter_cols, *diff_names, TARGET]
    series = series.backward_fill(fill)
    return series.df.withColumns({**flags_first, **flags_last}).select(*out_cols)


# The wider feature set of the exploratory notebooks.
def extended_config() -> FeatureConfig:
    from demandspark.config import DiffFeature, InteractionFeature, LagFeature, RollingFeature

    return FeatureConfig(
        lag_features=(
            LagFeature("cnt", (0, 1, 2, 23, 24)),
            LagFeature("hr", (1, 23, 24)),
            LagFeature("temp", (1, 2, 3)),
            LagFeature("hum", (1, 2, 3)),
        ),
        diff_features=(
            DiffFeature("cnt", (1, 24)),
            DiffFeature("hr", (1, 23, 24)),
            DiffFeature("temp", (1, 3, 24)),
            DiffFeature("hum", (1, 3)),
        ),
        interaction_features=(
            InteractionFeature("temp", "hum", "multiply"),
            InteractionFeature("temp", "hr", "multiply"),
            InteractionFeature("hum", "hr", "multiply"),
        ),
        rolling_features=(RollingFeature("temp", (3,)), RollingFeature("hum", (3,))),
    )
