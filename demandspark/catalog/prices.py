"""Pricing rules over the hourly table, each against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.catalog.base import HOURLY, HOURLY_CTE, hourly, query, r, r2, rp
from demandspark.config import BusinessConfig
from demandspark.functions import pricing as rules
from demandspark.functions.numeric import clip
from demandspark.operators import ordered as o
from demandspark.operators.ordered import OrderedFrame
from demandspark.plans import pricing as job
from demandspark.plans.features import build_features, target_column

CFG = BusinessConfig()
# Observed counts scaled so that busy hours reach (and some exceed) the capacity of 800.
DEMAND_SCALE = 40

TEMP_C = "(temp*47e0 + -8e0)"
WIND = "(windspeed*0.8507e0)"
T2, H2, W2 = rp(TEMP_C), rp("hum"), rp(WIND)
TEMP_CLASS = f"""cast(case when {T2} < 0 or {T2} > 35 then 4
  when {T2} between 0 and 9 or {T2} between 30 and 35 then 3
  when {T2} between 21 and 29 then 2 when {T2} between 10 and 20 then 1 else 4 end as tinyint)"""
HUM_CLASS = f"""cast(case when {H2} > 0.8e0 then 4 when {H2} < 0.2e0 then 3
  when {H2} between 0.2e0 and 0.39e0 or {H2} between 0.61e0 and 0.8e0 then 2
  when {H2} between 0.4e0 and 0.6e0 then 1 else 4 end as tinyint)"""
WIND_CLASS = f"""cast(case when {W2} > 50 then 4 when {W2} between 26 and 50 then 3
  when {W2} between 16 and 25 then 2 else 1 end as tinyint)"""
WEATHER = r2(
    "least(greatest((0.4e0 + 0.25e0*temp_class + 0.1e0*hum_class + 0.16e0*wind_class)"
    "*(0.33e0*weather_class), 0.85e0), 1.48e0)"
)
PEAK_C = "hr in (7,8,9,17,18,19)"
NORMS = {
    "mnth": "(coalesce(mnth,6)-1)/11e0",
    "holiday": "cast(coalesce(holiday,0) as double)",
    "hr": f"case when {PEAK_C} then 0.8e0+0.2e0*(hr%24)/23e0 else (hr%24)/23e0 end",
    "weekday": "coalesce(weekday,3)/6e0",
    "workingday": "cast(coalesce(workingday,1) as double)",
    "weathersit": "1e0-(coalesce(weathersit,1)-1)/3e0",
    "temp": "case when temp between 0.6e0 and 0.8e0 then temp else temp*0.8e0 end",
    "hum": "1e0-coalesce(hum,0.5e0)",
    "windspeed": "1e0-coalesce(windspeed,0.2e0)",
    "cnt": "least(coalesce(cnt,200)/1000e0, 1e0)",
}
SCORE = "0e0" + "".join(f" + ({NORMS[k]})*{w}e0" for k, w in rules.COMPETITOR_WEIGHTS.items())
COMP_PRICE = r(
    f"least(greatest(3099.99e0 + ({SCORE})*(6250.50e0-3099.99e0), 3099.99e0), 6250.50e0)"
)
TIME = """case when hr in (7,8,9,16,17,18) then 1.48e0
  when hr in (10,11,12,13,14,15,19,20) then 1.30e0 else 0.92e0 end"""
COMP_FACTOR = (
    f"least(greatest({r2('1e0 - 0.45e0*((3550.50e0-competitor_price)/3550.50e0)')}, 0.85e0), 1.5e0)"
)
UTIL = "((800e0-(800e0-demand))/800e0)"
ELASTICITY = f"case when {UTIL} between 0 and 1 then {r2(f'-1.1e0*(0.6e0*weather_factor + (1e0-{UTIL}))')} end"
MULTIPLIER = f"""case when {UTIL} <= 1 and elasticity <> 0 then
  {r2(f"0.662e0*comp_factor*(1e0+0.662e0*{UTIL})*time_factor*(1e0/abs(elasticity))")} end"""
PRICE = f"case when price_multiplier > 0 then least(greatest({r2('3550.50e0*price_multiplier')}, 3008.50e0), 5999.99e0) end"

WEATHER_CTE = f"""{HOURLY_CTE},
w0 as (select *, {TEMP_CLASS} as temp_class, {HUM_CLASS} as hum_class, {WIND_CLASS} as wind_class,
  cast(weathersit as tinyint) as weather_class from hourly),
w1 as (select *, {WEATHER} as weather_factor from w0)"""


def price_ctes(source: str, demand: str) -> str:
    """CTEs p0..p6 that price ``source`` (which has weather_factor) for a demand text."""
    return f"""
p0 as (select *, cast({demand} as double) as demand, {COMP_PRICE} as competitor_price, {TIME} as time_factor from {source}),
p1 as (select *, {COMP_FACTOR} as comp_factor, {ELASTICITY} as elasticity from p0),
p2 as (select *, {MULTIPLIER} as price_multiplier from p1),
p3 as (select *, {PRICE} as price from p2),
p4 as (select *, {r2('price - 3550.50e0')} as delta from p3),
p5 as (select *, case when delta is null then null when delta > 0 then delta else 0e0 end as surge,
  case when delta is null then null when delta < 0 then delta else 0e0 end as discount,
  case when demand > 800 then 'demand_above_capacity' end as error from p4)"""


PRICE_SELECT = """3550.50e0 as base_price, price, competitor_price, price_multiplier, surge, discount,
  3008.50e0 as min_price, 5999.99e0 as max_price, demand, 'NGN' as currency"""
DEMAND = f"cnt*{DEMAND_SCALE}"


@query("r01_celsius", f"with {HOURLY_CTE} select datetime, {TEMP_C} as temp_c, {WIND} as wind from hourly")
def _celsius(spark, sf):
    return hourly(spark, sf).select(
        "datetime",
        rules.celsius(F.col("temp")).alias("temp_c"),
        rules.wind_speed(F.col("windspeed")).alias("wind"),
    )


@query(
    "r02_weather_classes",
    f"with {WEATHER_CTE} select datetime, temp_class, hum_class, wind_class, weather_class from w0",
)
def _classes(spark, sf):
    return hourly(spark, sf).select(
        "datetime", *[c.alias(n) for n, c in rules.weather_columns().items()]
    )


@query("r07_weather_factor", f"with {WEATHER_CTE} select datetime, weather_factor from w1")
def _weather(spark, sf):
    return job.add_weather_factor(hourly(spark, sf)).select("datetime", "weather_factor")


@query(
    "r08_elasticity",
    f"""with {WEATHER_CTE}, d as (select *, cast({DEMAND} as double) as demand from w1)
    select datetime, {ELASTICITY} as elasticity from d""",
)
def _elasticity(spark, sf):
    df = job.add_weather_factor(hourly(spark, sf))
    util = rules.utilization((F.col("cnt") * DEMAND_SCALE).cast("double"), CFG.max_capacity)
    return df.select(
        "datetime",
        rules.dynamic_elasticity(CFG.base_elasticity, util, F.col("weather_factor")).alias("elasticity"),
    )


@query("r09_time_factor", f"with {HOURLY_CTE} select datetime, {TIME} as time_factor from hourly")
def _time(spark, sf):
    return hourly(spark, sf).select("datetime", rules.time_factor(F.col("hr")).alias("time_factor"))


@query(
    "r10_competitor_factor",
    f"""with {HOURLY_CTE}, c as (select *, {COMP_PRICE} as competitor_price from hourly)
    select datetime, {COMP_FACTOR} as comp_factor from c""",
)
def _comp_factor(spark, sf):
    df = job.add_competitor_price(hourly(spark, sf), CFG.min_competitor_price, CFG.max_competitor_price)
    return df.select(
        "datetime",
        rules.competitor_factor(F.lit(CFG.base_price), F.col("competitor_price")).alias("comp_factor"),
    )


@query(
    "r11_price_multiplier",
    f"with {WEATHER_CTE}, {price_ctes('w1', DEMAND)} select datetime, demand, price_multiplier from p5",
)
def _multiplier(spark, sf):
    df = job.price_table(hourly(spark, sf), demand=F.col("cnt") * DEMAND_SCALE, keep=["datetime"])
    return df.select("datetime", "demand", "price_multiplier")


@query(
    "r13_price_table",
    f"with {WEATHER_CTE}, {price_ctes('w1', DEMAND)} select datetime, {PRICE_SELECT}, error from p5",
)
def _price_table(spark, sf):
    return job.price_table(hourly(spark, sf), demand=F.col("cnt") * DEMAND_SCALE, keep=["datetime"])


@query(
    "r12_price_events",
    f"""with {HOURLY_CTE}, e as (
      select event_id, cast(hour(ts) as bigint) as hr, cast(month(ts) as bigint) as mnth,
        cast(isodow(ts)-1 as bigint) as weekday,
        cast(case when isodow(ts) < 6 and cast(ts as date) not in (date '2024-01-01', date '2024-01-15') then 1 else 0 end as bigint) as workingday,
        cast(case when cast(ts as date) in (date '2024-01-01', date '2024-01-15') then 1 else 0 end as bigint) as holiday,
        cast(1 + user_id % 4 as bigint) as weathersit, ((event_id*37)%101)/100e0 as temp,
        ((event_id*53)%101)/100e0 as hum, ((event_id*71)%86)/100e0 as windspeed,
        cast((event_id*97)%1200 as bigint) as cnt from events),
    w0 as (select *, {TEMP_CLASS} as temp_class, {HUM_CLASS} as hum_class, {WIND_CLASS} as wind_class,
      cast(weathersit as tinyint) as weather_class from e),
    w1 as (select *, {WEATHER} as weather_factor from w0), {price_ctes('w1', 'cnt')}
    select event_id, {PRICE_SELECT}, error from p5""",
)
def _price_events(spark, sf):
    """Every event priced as a request of its own: one projection over the raw table."""
    from demandspark.catalog.base import table
    from demandspark.operators.calendar import add_calendar

    ev = add_calendar(table(spark, sf, "events"), "ts")
    c = F.col("event_id")
    req = ev.withColumns(
        {
            "weathersit": (1 + F.col("user_id") % 4).cast("bigint"),
            "temp": ((c * 37) % 101) / F.lit(100.0),
            "hum": ((c * 53) % 101) / F.lit(100.0),
            "windspeed": ((c * 71) % 86) / F.lit(100.0),
            "cnt": (c * 97) % 1200,
        }
    )
    return job.price_table(req, demand="cnt", keep=["event_id"])


@query(
    "r14_capacity",
    f"""with {HOURLY_CTE}, d as (select datetime, {DEMAND} as demand from hourly)
    select datetime, cast(800 as bigint) as max_capacity, cast(demand as bigint) as current_utilization,
      cast(800-demand as bigint) as available, {r2('demand/800e0')} as utilization_rate from d""",
)
def _capacity(spark, sf):
    df = hourly(spark, sf).select("datetime", (F.col("cnt") * DEMAND_SCALE).alias("demand"))
    return job.add_capacity(df).drop("demand")


@query(
    "r15_response",
    f"""with {WEATHER_CTE}, {price_ctes('w1', DEMAND)}
    select datetime, case when error is null then 'success' else 'failed' end as status,
      case when error is null then {r2('demand/800e0')} end as utilization_rate,
      case when error is null then price end as price, case when error is null then surge end as surge,
      case when error is null then discount end as discount, error from p5""",
)
def _response(spark, sf):
    df = job.price_table(hourly(spark, sf), demand=F.col("cnt") * DEMAND_SCALE, keep=["datetime"])
    out = job.response(job.add_capacity(df))
    return out.select(
        "datetime",
        "status",
        "capacity_components.utilization_rate",
        "price_components.price",
        "price_components.surge",
        "price_components.discount",
        "error",
    )


@query(
    "c01_competitor_norms",
    f"with {HOURLY_CTE} select datetime, "
    + ", ".join(f"{v} as {k}_norm" for k, v in NORMS.items())
    + " from hourly",
)
def _norms(spark, sf):
    df = hourly(spark, sf)
    return df.select("datetime", *[c.alias(f"{n}_norm") for n, c in rules.competitor_norms().items()])


@query("c02_competitor_score", f"with {HOURLY_CTE} select datetime, {SCORE} as base_score from hourly")
def _score(spark, sf):
    return hourly(spark, sf).select("datetime", rules.competitor_score().alias("base_score"))


@query(
    "c03_competitor_price", f"with {HOURLY_CTE} select datetime, {COMP_PRICE} as predicted_price from hourly"
)
def _comp_price(spark, sf):
    df = job.add_competitor_price(
        hourly(spark, sf), CFG.min_competitor_price, CFG.max_competitor_price, name="predicted_price"
    )
    return df.select("datetime", "predicted_price")


NAIVE_CTE = """
n0 as (select *, lag(cnt, 24) over (order by datetime) as l24, lag(cnt, 1) over (order by datetime) as l1 from w1),
n1 as (select *, coalesce(l24, l1, cnt) as naive from n0)"""


@query(
    "r16_price_forecast",
    f"""with {WEATHER_CTE}, {NAIVE_CTE}, {price_ctes('n1', f'least(naive*{DEMAND_SCALE}, 800)')}
    select datetime, {PRICE_SELECT}, error from p5""",
)
def flagship(spark, sf):
    """Price of every hour for a naive demand forecast (a day before, else an hour before)."""
    ops = [o.lag("cnt", 24, "l24"), o.lag("cnt", 1, "l1")]
    df = OrderedFrame(hourly(spark, sf), HOURLY).with_ops(ops).df
    naive = F.coalesce("l24", "l1", "cnt") * DEMAND_SCALE
    return job.price_table(df, demand=clip(naive, 0, CFG.max_capacity), keep=["datetime"])
