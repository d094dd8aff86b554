"""Statistics along a series: autocorrelation and the naive forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators import ordered as o
from demandspark.operators.ordered import OrderedFrame, SeriesSpec


def autocorrelation(df: DataFrame, col: str, spec: SeriesSpec, max_lag: int = 24) -> DataFrame:
    """(keys..., lag, autocorrelation) for lag 1..max_lag over complete pairs.

    All lags come from one window stage. Each row is then one (lag, pair) entry per lag and
    the entries are summed map-side, so only one row per lag and task is shuffled. Null with
    one pair or none, or when a side is constant.
    """
    keys = list(spec.partition_by)
    names = [f"__l{k}" for k in range(1, max_lag + 1)]
    narrow = df.select(*spec.columns, F.col(col).cast("double").alias("__x"))
    ops = [o.lag("__x", k + 1, n) for k, n in enumerate(names)]
    lagged = OrderedFrame(narrow, spec).with_ops(ops).df
    entries = F.array(*[F.struct(F.lit(k + 1).alias("lag"), F.col(n).alias("__y")) for k, n in enumerate(names)])
    pairs = lagged.select(*keys, "__x", F.inline(entries))
    both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    x, y = F.when(both, F.col("__x")), F.when(both, F.col("__y"))
    wide = pairs.groupBy(*keys, "lag").agg(
        F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("a"), F.stddev_pop(y).alias("b"), F.count_if(both).alias("n")
    )
    r = F.when(F.col("n") > 1, F.try_divide("c", F.col("a") * F.col("b")))
    return wide.select(*keys, "lag", r.alias("autocorrelation"))


def top_autocorrelation(ac: DataFrame, n: int = 10) -> DataFrame:
    """Lags with the highest autocorrelation; a null counts as -1."""
    return ac.orderBy(F.coalesce("autocorrelation", F.lit(-1.0)).desc(), "lag").limit(n)


def naive_forecast(df: DataFrame, col: str, spec: SeriesSpec, lag: int = 1, name: str = "yhat") -> DataFrame:
    """The value ``lag`` rows earlier; the first rows take the first forecast."""
    return OrderedFrame(df, spec).with_ops([o.lag(col, lag, name)]).backward_fill([name]).df
