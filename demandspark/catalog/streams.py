"""Streaming queries: the events file is drained as a stream, then compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.catalog.base import query, r2
from demandspark.catalog.prices import HUM_CLASS, PRICE_SELECT, TEMP_CLASS, WEATHER, WIND_CLASS, price_ctes
from demandspark.operators import ordered as o
from demandspark.operators.calendar import add_calendar
from demandspark.operators.ordered import SeriesSpec
from demandspark.session import scratch_path
from demandspark.streaming import jobs

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark, sf):
    return jobs.read_stream(spark, sf, EVENT_SCHEMA, glob="events.parquet")


def _drain(spark, df, name):
    out, chk = scratch_path(spark, name), scratch_path(spark, f"{name}-chk")
    schema = df.schema
    jobs.write_files(df, out, chk).awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query(
    "x01_stream_pricing",
    f"""with e0 as (
      select event_id, cast(hour(ts) as bigint) as hr, cast(month(ts) as bigint) as mnth,
        cast(isodow(ts)-1 as bigint) as weekday,
        cast(case when isodow(ts) < 6 and cast(ts as date) not in (date '2024-01-01', date '2024-01-15') then 1 else 0 end as bigint) as workingday,
        cast(case when cast(ts as date) in (date '2024-01-01', date '2024-01-15') then 1 else 0 end as bigint) as holiday,
        cast(user_id % 6 as bigint) as weathersit, ((event_id*37)%1050)/1000e0 as temp0,
        ((event_id*53)%1010)/1000e0 as hum0, ((event_id*71)%860)/1000e0 as windspeed0,
        cast((event_id*97)%1200 as bigint) as cnt from events),
    e as (select *, {r2('temp0')} as temp, {r2('hum0')} as hum, {r2('windspeed0')} as windspeed,
      rtrim(case when weathersit < 1 or weathersit > 4 then 'weathersit,' else '' end
        || case when temp0 > 1 then 'temp,' else '' end || case when hum0 > 1 then 'hum,' else '' end, ',') as v from e0),
    w0 as (select *, {TEMP_CLASS} as temp_class, {HUM_CLASS} as hum_class, {WIND_CLASS} as wind_class,
      cast(weathersit as tinyint) as weather_class from e),
    w1 as (select *, case when weather_class between 1 and 4 then {WEATHER} end as weather_factor from w0),
    {price_ctes('w1', 'cnt')},
    q as (select event_id, v, {PRICE_SELECT}, error from p5)
    select event_id, base_price, case when v = '' then price end as price,
      case when v = '' then competitor_price end as competitor_price,
      case when v = '' then price_multiplier end as price_multiplier, case when v = '' then surge end as surge,
      case when v = '' then discount end as discount, min_price, max_price, demand, currency,
      case when v <> '' then 'input:' || v else error end as error from q""",
)
def _price_stream(spark, sf):
    ev = add_calendar(_events(spark, sf), "ts")
    c = F.col("event_id")
    req = ev.withColumns(
        {
            "weathersit": (F.col("user_id") % 6).cast("bigint"),
            "temp": ((c * 37) % 1050) / F.lit(1000.0),
            "hum": ((c * 53) % 1010) / F.lit(1000.0),
            "windspeed": ((c * 71) % 860) / F.lit(1000.0),
            "cnt": (c * 97) % 1200,
        }
    )
    return _drain(spark, jobs.price_stream(req, demand="cnt", keep=["event_id"]), "price-stream")


CLOSED = """allh as (select event_type, date_trunc('hour', ts)::timestamp as datetime, count(*) as cnt,
    cast(sum(user_id) as bigint) as users_sum from events group by 1, 2),
  closed as (select * from allh
    where datetime + interval 1 hour <= (select max(ts) from events) - interval 2 hour)"""


def _aggs():
    return {"cnt": F.count(F.lit(1)), "users_sum": F.sum("user_id")}


def _hours(spark, sf):
    return jobs.hourly_stream(_events(spark, sf), "ts", _aggs(), ["event_type"])


@query("x02_stream_hourly_demand", f"with {CLOSED} select event_type, datetime, cnt, users_sum from closed")
def _hourly_stream(spark, sf):
    return _drain(spark, _hours(spark, sf), "hour-stream")


@query(
    "x04_stream_hours_with_closing_step",
    f"with {CLOSED} select event_type, datetime, cnt, users_sum from allh",
)
def _all_hours(spark, sf):
    closed = _drain(spark, _hours(spark, sf), "hour-stream")
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    return closed.unionByName(jobs.open_hours(events, closed, "ts", _aggs(), ["event_type"]))


X_W = "(partition by event_type order by datetime)"


@query(
    "x03_stream_lag_features",
    f"""with {CLOSED} select event_type, datetime, cnt, users_sum, cast(coalesce(lag(cnt, 1) over {X_W}, -1) as bigint) as lag_1,
      cast(coalesce(lag(cnt, 24) over {X_W}, -1) as bigint) as lag_24,
      case when count(cnt) over {X_W[:-1]} rows 2 preceding) = 3 then avg(cnt) over {X_W[:-1]} rows 2 preceding) end as mean_3
    from closed""",
)
def _lag_stream(spark, sf):
    ops = [o.lag("cnt", 1, "lag_1"), o.lag("cnt", 24, "lag_24"), o.rolling_mean("cnt", 3, "mean_3")]
    spec = SeriesSpec(("datetime",), ("event_type",), mode="plain")
    out = scratch_path(spark, "lag-stream")
    hours = _hours(spark, sf)
    jobs.lag_feature_stream(hours, spec, ops, out, f"{out}-state", f"{out}-chk").awaitTermination()
    df = spark.read.parquet(out).drop("epoch")
    return df.withColumns({c: F.coalesce(c, F.lit(-1)).cast("bigint") for c in ("lag_1", "lag_24")})


# Three days arrive at a time; one event in forty comes two days late, in a later batch.
DELIVERED = "cast(floor((day(ts) - 1 + case when event_id % 40 = 0 then 2 else 0 end) / 3) as bigint)"


@query(
    "x05_stream_hours_accounted",
    f"""with e as (select *, {DELIVERED} as batch, date_trunc('hour', ts)::timestamp as datetime from events),
    b as (select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding) as seen, max(max(ts)) over () as last from e group by batch),
    f as (select e.*, case when datetime + interval 1 hour <= seen - interval 2 hour then 'late'
        when datetime + interval 1 hour <= last - interval 2 hour then 'closed' else 'open' end as part from e join b using (batch))
    select part, event_type, datetime, count(*) as cnt, cast(sum(user_id) as bigint) as users_sum from f group by 1, 2, 3""",
)
def _accounted(spark, sf):
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet").withColumn("batch", F.expr(DELIVERED))
    source = jobs.files_by_batch(events, "batch", scratch_path(spark, "events-staged"), scratch_path(spark, "events-by-batch"))
    tables = jobs.HourlyTables(scratch_path(spark, "accounted"))
    stream = jobs.read_stream(spark, f"{source}/*", EVENT_SCHEMA, files_per_batch=1)
    aggs = {"cnt": ("count", "event_id"), "users_sum": ("sum", "user_id")}
    jobs.accounted_hours(stream, "ts", aggs, ["event_type"], tables, scratch_path(spark, "accounted-chk")).awaitTermination()
    late = tables.late(spark).groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("datetime")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("user_id").alias("users_sum"))
    parts = {"closed": tables.closed(spark), "open": tables.open(spark), "late": late}
    cols = ["event_type", "datetime", "cnt", "users_sum"]
    out = [df.select(F.lit(name).alias("part"), *cols) for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
