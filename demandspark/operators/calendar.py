"""Hourly spine, calendar columns, event counting and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions import calendar as cal


def hours_between(spark: SparkSession, start_day: str, end_day: str, name: str = "datetime") -> DataFrame:
    """Every hour from ``start_day`` 00:00 to ``end_day`` 23:00."""
    days = spark.range(1).select(
        F.to_timestamp(F.lit(start_day), "yyyy-MM-dd").alias("a"),
        (F.to_timestamp(F.lit(end_day), "yyyy-MM-dd") + F.expr("interval 23 hours")).alias("b"),
    )
    return _hours(days, [], name)


def hourly_spine(df: DataFrame, ts: str, keys: Sequence[str] = (), name: str = "datetime") -> DataFrame:
    """All hours of the days a table covers, per key; first day 00:00 to last day 23:00."""
    span = df.groupBy(*keys).agg(F.min(ts).cast("timestamp").alias("a"), F.max(ts).cast("timestamp").alias("b"))
    span = span.where(F.col("a").isNotNull()).select(
        *keys,
        F.date_trunc("day", "a").alias("a"),
        (F.date_trunc("day", "b") + F.expr("interval 23 hours")).alias("b"),
    )
    return _hours(span, keys, name)


def _hours(span: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    hours = F.explode(F.sequence(F.col("a"), F.col("b"), F.expr("interval 1 hour")))
    return span.select(*keys, hours.alias(name))


def add_calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """season, yr, mnth, hr, weekday, holiday, workingday from a timestamp column."""
    cols = cal.calendar_columns(F.col(ts))
    holiday = cal.holiday_flag(F.col(ts).cast("date"))
    return df.withColumns({**cols, "holiday": holiday}).withColumn(
        "workingday", cal.working_day(F.col("weekday"), F.col("holiday"))
    )


def hourly_totals(
    df: DataFrame, ts: str, aggs: dict[str, Column], keys: Sequence[str] = (), name: str = "datetime"
) -> DataFrame:
    """Aggregate events per hour (and key); partial sums are built before the shuffle."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp").alias(name)
    return df.groupBy(*keys, hour).agg(*[c.alias(n) for n, c in aggs.items()])


def fill_hours(
    hourly: DataFrame, spine: DataFrame, fill: dict[str, int | float], keys: Sequence[str] = (), name: str = "datetime"
) -> DataFrame:
    """Put hourly rows on the spine; ``fill`` gives the value of columns in empty hours."""
    on = [*keys, name]
    out = spine.join(hourly, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
