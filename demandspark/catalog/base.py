"""Registry of named queries and the views they share over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.operators import calendar as kal
from demandspark.operators.ordered import SeriesSpec
from demandspark.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equivalent statement on the same tables."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return io.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table or its ``cols``."""
    df = table(spark, sf_dir, name)
    return df.select(*cols) if cols else df


def hourly(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """``hourly_demand`` (16 columns) counted from ``events``.

    Weather readings are stand-ins of the right type and range, derived from integer
    sums so that every engine gets the same doubles.
    """
    ev = table(spark, sf_dir, "events")
    keys = []
    if key:  # hours of each value of an expression
        ev, keys = ev.withColumn("key", F.expr(key)), ["key"]
    is_casual = F.col("event_type").isin("click", "view")
    totals = kal.hourly_totals(
        ev,
        "ts",
        {
            "cnt": F.count(F.lit(1)),
            "casual": F.count_if(is_casual),
            "err": F.count_if(F.col("event_type") == "error"),
            "users": F.count_distinct("user_id"),
            "mx": F.max("event_id"),
            "cents": F.sum(F.round(F.col("value") * 100).cast("bigint")),
        },
        keys,
    )
    temp = F.least(F.lit(1.0), F.col("cents") / (F.col("cnt") * F.lit(10000.0)))
    return kal.add_calendar(totals).select(
        *keys,
        "datetime",
        "season",
        "yr",
        "mnth",
        "hr",
        "holiday",
        "weekday",
        "workingday",
        (1 + F.col("err") % 4).cast("bigint").alias("weathersit"),
        temp.alias("temp"),
        temp.alias("atemp"),
        (((F.col("mx") * 37) % 101) / F.lit(100.0)).alias("hum"),
        (((F.col("users") * 7) % 86) / F.lit(100.0)).alias("windspeed"),
        "casual",
        (F.col("cnt") - F.col("casual")).alias("registered"),
        "cnt",
    )


# One row per hour of the calendar: a century is under a million rows, so one task fits.
HOURLY = SeriesSpec(("datetime",), mode="plain")
LINEITEM = SeriesSpec(("l_shipdate", "l_orderkey", "l_linenumber"), ("l_partkey",))
ORDERS = SeriesSpec(("o_orderdate", "o_orderkey"), ("o_custkey",))
EVENTS = SeriesSpec(("ts", "event_id"), ("user_id",))

HOURLY_CTE = """
h0 as (
  select date_trunc('hour', ts) as dt, count(*) as cnt,
    sum(case when event_type in ('click','view') then 1 else 0 end) as casual,
    sum(case when event_type = 'error' then 1 else 0 end) as err,
    count(distinct user_id) as users, max(event_id) as mx,
    sum(cast(round(value*100) as bigint)) as cents
  from events group by 1),
hourly as (
  select cast(dt as timestamp) as datetime,
    cast(case when month(dt) in (3,4,5) then 1 when month(dt) in (6,7,8) then 2
         when month(dt) in (9,10,11) then 3 else 4 end as bigint) as season,
    cast(year(dt)-2011 as bigint) as yr, cast(month(dt) as bigint) as mnth, cast(hour(dt) as bigint) as hr,
    cast(case when cast(dt as date) in (date '2024-01-01', date '2024-01-15') then 1 else 0 end as bigint) as holiday,
    cast(isodow(dt)-1 as bigint) as weekday,
    cast(case when isodow(dt) < 6 and cast(dt as date) not in (date '2024-01-01', date '2024-01-15')
         then 1 else 0 end as bigint) as workingday,
    cast(1+(err%4) as bigint) as weathersit,
    least(cast(1 as double), cents/(cnt*cast(10000 as double))) as temp,
    least(cast(1 as double), cents/(cnt*cast(10000 as double))) as atemp,
    ((mx*37)%101)/cast(100 as double) as hum,
    ((users*7)%86)/cast(100 as double) as windspeed,
    cast(casual as bigint) as casual, cast(cnt-casual as bigint) as registered, cast(cnt as bigint) as cnt
  from h0)
"""


def r(expr: str, digits: int = 2) -> str:
    """SQL text of rounding half up."""
    s = f"{10**digits}e0"
    return f"(floor(({expr})*{s}+0.5e0)/{s})"


def r6(expr: str) -> str:
    return r(expr, 6)


def r2(expr: str) -> str:
    """SQL text of rounding at 2 decimals by exact binary value, ties to even."""
    x = f"cast({expr} as double)"
    a = f"abs({x})"
    c = f"floor({a}*100e0+0.5e0)"
    hi = f"({a}*134217729e0-({a}*134217729e0-{a}))"
    over = f"((200e0*{hi}-(2e0*{c}-1e0))+200e0*({a}-{hi}))"
    return f"(sign({x})*({c}-case when {over} > 0 then 0 when {over} < 0 then 1 else {c}%2 end)/100e0+0e0)"


def rp(expr: str) -> str:
    """SQL text of rounding the product with 100, ties to even."""
    return f"(round_even(({expr})*100e0, 0)/100e0)"
