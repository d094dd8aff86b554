"""Ordered-series queries, each against its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from demandspark.catalog.base import (
    EVENTS,
    HOURLY,
    HOURLY_CTE,
    LINEITEM,
    ORDERS,
    hourly,
    query,
    r6,
    table,
)
from demandspark.config import FeatureConfig
from demandspark.functions import calendar as cal
from demandspark.functions.numeric import interaction, round6
from demandspark.operators import ordered as o
from demandspark.operators import seriesstats as st
from demandspark.operators.ordered import OrderedFrame, SeriesSpec
from demandspark.plans import features as ft

LI_KEY = "l_orderkey, l_linenumber"
LI_W = "(partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber)"
LI_U = "(order by l_partkey, l_shipdate, l_orderkey, l_linenumber)"
EV_W = "(partition by user_id order by ts, event_id)"
H_W = "(order by datetime)"
LI_COLS = ["l_orderkey", "l_linenumber"]
# The whole table as one single series, cut into ranges.
LI_CHUNKED = replace(LINEITEM, max_rows=7_000, mode="chunked")
LI_SINGLE = o.SeriesSpec(
    ("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber"), max_rows=7_000, mode="chunked"
)


def _li(spark, sf, *cols):
    names = [*LINEITEM.columns, *cols]
    return table(spark, sf, "lineitem").select(*dict.fromkeys(names))


def _frame(w: str, rows: int) -> str:
    return f"{w[:-1]} rows between {rows - 1} preceding and current row)"


def roll_sql(col: str, w: str, rows: int, fn: str) -> str:
    f = _frame(w, rows)
    return f"case when count({col}) over {f} = {rows} then {fn}({col}) over {f} end"


@query(
    "f01_lag",
    f"""select {LI_KEY}, lag(l_quantity, 0) over {LI_W} as qty_lag_0, lag(l_quantity, 1) over {LI_W} as qty_lag_1,
    lag(l_quantity, 24) over {LI_W} as qty_lag_24 from lineitem""",
)
def _lag(spark, sf):
    ops = [o.lag("l_quantity", k, f"qty_lag_{k}") for k in (0, 1, 24)]
    return OrderedFrame(_li(spark, sf, "l_quantity"), LINEITEM).with_ops(ops).df.select(
        *LI_COLS, *[op.name for op in ops]
    )


@query(
    "f01_lag_hot_key_chunks",
    f"""select {LI_KEY}, lag(l_quantity, 1) over {LI_W} as qty_lag_1, lag(l_quantity, 24) over {LI_W} as qty_lag_24,
    lead(l_quantity, 1) over {LI_W} as qty_lead_1 from lineitem""",
)
def _lag_chunked(spark, sf):
    ops = [o.lag("l_quantity", k, f"qty_lag_{k}") for k in (1, 24)]
    ops.append(o.lead("l_quantity", 1, "qty_lead_1"))
    return OrderedFrame(_li(spark, sf, "l_quantity"), LI_CHUNKED).with_ops(ops).df.select(
        *LI_COLS, *[op.name for op in ops]
    )


@query(
    "f01_single_series_chunks",
    f"""select {LI_KEY}, row_number() over {LI_U} - 1 as index, lag(l_quantity, 24) over {LI_U} as qty_lag_24,
    {roll_sql("l_quantity", LI_U, 6, "avg")} as qty_mean_6,
    {roll_sql("l_quantity", LI_U, 6, "median")} as qty_median_6,
    cast(sum(l_linenumber) over ({LI_U[1:-1]} rows unbounded preceding) as bigint) as lines_so_far,
    last_value(case when l_returnflag = 'R' and l_linenumber > 6 then l_quantity end ignore nulls)
      over ({LI_U[1:-1]} rows unbounded preceding) as last_returned,
    first_value(case when l_returnflag = 'R' and l_linenumber > 6 then l_quantity end ignore nulls)
      over ({LI_U[1:-1]} rows between current row and unbounded following) as next_returned
    from lineitem""",
)
def _single(spark, sf):
    df = _li(spark, sf, "l_quantity", "l_returnflag")
    returned = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 6), F.col("l_quantity"))
    df = df.withColumns({"last_returned": returned, "next_returned": returned})
    ops = [
        o.lag("l_quantity", 24, "qty_lag_24"),
        o.rolling_mean("l_quantity", 6, "qty_mean_6"),
        o.rolling_median("l_quantity", 6, "qty_median_6"),
    ]
    s = OrderedFrame(df, LI_SINGLE).with_ops(ops).row_index().running_sum("l_linenumber", "lines_so_far")
    s = s.forward_fill(["last_returned"]).backward_fill(["next_returned"])
    return s.df.select(
        *LI_COLS, "index", *[op.name for op in ops], "lines_so_far", "last_returned", "next_returned"
    )


@query(
    "f02_target",
    f"""with {HOURLY_CTE}, a as (select datetime, cnt, lead(cnt) over {H_W} as nxt from hourly)
    select datetime, cnt, last_value(nxt ignore nulls) over (order by datetime rows unbounded preceding) as target from a""",
)
def _target(spark, sf):
    s = ft.target_column(OrderedFrame(hourly(spark, sf).select("datetime", "cnt"), HOURLY), "cnt")
    return s.df


@query(
    "f02_target_keyed",
    f"""with a as (select event_id, user_id, ts, value, lead(value) over {EV_W} as nxt from events)
    select event_id, last_value(nxt ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as target from a""",
)
def _target_keyed(spark, sf):
    df = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return ft.target_column(OrderedFrame(df, EVENTS), "value").df.select("event_id", "target")


@query(
    "f03_difference",
    f"""select o_orderkey, o_totalprice - lag(o_totalprice, 1) over w as diff_1,
    o_totalprice - lag(o_totalprice, 2) over w as diff_2 from orders
    window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
)
def _diff(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    ops = [o.difference("o_totalprice", k, f"diff_{k}") for k in (1, 2)]
    return OrderedFrame(df, ORDERS).with_ops(ops).df.select("o_orderkey", "diff_1", "diff_2")


@query(
    "f04_rolling_mean",
    f"""select {LI_KEY}, {roll_sql("l_quantity", LI_W, 3, "avg")} as mean_3,
    {roll_sql("l_quantity", LI_W, 6, "avg")} as mean_6 from lineitem""",
)
def _roll_mean(spark, sf):
    ops = [o.rolling_mean("l_quantity", w, f"mean_{w}") for w in (3, 6)]
    return OrderedFrame(_li(spark, sf, "l_quantity"), LINEITEM).with_ops(ops).df.select(
        *LI_COLS, "mean_3", "mean_6"
    )


@query(
    "f05_rolling_median",
    f"""select {LI_KEY}, {roll_sql("l_extendedprice", LI_W, 3, "median")} as median_3,
    {r6(roll_sql("l_extendedprice", LI_W, 6, "median"))} as median_6 from lineitem""",
)
def _roll_median(spark, sf):
    ops = [o.rolling_median("l_extendedprice", w, f"median_{w}") for w in (3, 6)]
    df = OrderedFrame(_li(spark, sf, "l_extendedprice"), LINEITEM).with_ops(ops).df
    return df.select(*LI_COLS, "median_3", round6(F.col("median_6")).alias("median_6"))


SPARSE = "case when event_id % 3 = 0 then value end"


@query(
    "f06_backward_fill",
    f"""with a as (select *, {SPARSE} as v from events)
    select event_id, first_value(v ignore nulls) over (partition by user_id order by ts, event_id
      rows between current row and unbounded following) as v from a""",
)
def _bfill(spark, sf):
    df = table(spark, sf, "events").selectExpr("user_id", "ts", "event_id", f"{SPARSE} as v")
    return OrderedFrame(df, EVENTS).backward_fill(["v"]).df.select("event_id", "v")


@query(
    "f07_forward_fill",
    f"""with a as (select *, {SPARSE} as v from events)
    select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id
      rows unbounded preceding) as v from a""",
)
def _ffill(spark, sf):
    df = table(spark, sf, "events").selectExpr("user_id", "ts", "event_id", f"{SPARSE} as v")
    return OrderedFrame(df, EVENTS).forward_fill(["v"]).df.select("event_id", "v")


@query(
    "f08_fill_statistic",
    f"""with a as (select event_id, {SPARSE} as v, case when event_id % 5 = 0 then user_id end as u from events)
    select event_id, coalesce(v, (select min(v) from a)) as v_min, coalesce(u, (select max(u) from a)) as u_max,
    {r6("coalesce(cast(u as double), (select sum(u)/cast(count(u) as double) from a))")} as u_mean from a""",
)
def _fill_stat(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id",
        f"{SPARSE} as v_min",
        "case when event_id % 5 = 0 then user_id end as u_max",
        "case when event_id % 5 = 0 then user_id end as u_mean",
    )
    df = ft.fill_nulls(df, "min", cols=["v_min"])
    df = ft.fill_nulls(df, "max", cols=["u_max"])
    df = ft.fill_nulls(df, "mean", cols=["u_mean"])
    return df.withColumn("u_mean", round6(F.col("u_mean")))


@query(
    "f09_fill_constant",
    f"select event_id, coalesce({SPARSE}, 0) as v0, coalesce({SPARSE}, 1) as v1 from events",
)
def _fill_const(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{SPARSE} as v0", f"{SPARSE} as v1")
    return ft.fill_nulls(ft.fill_nulls(df, "zero", cols=["v0"]), "one", cols=["v1"])


@query(
    "f10_weekend_flag",
    f"with {HOURLY_CTE} select datetime, cast(weekday in (5,6) as tinyint) as is_weekend from hourly",
)
def _weekend(spark, sf):
    return hourly(spark, sf).select("datetime", *[c.alias(n) for n, c in ft.temporal_flag().items()])


CYCLIC = {
    "sin_hour": "sin(hr*(2*pi()/24))",
    "cos_hour": "cos(hr*(2*pi()/24))",
    "sin_weekday": "sin(weekday*(2*pi()/7))",
    "cos_weekday": "cos(weekday*(2*pi()/7))",
}


@query(
    "f11_cyclical",
    f"with {HOURLY_CTE} select datetime, "
    + ", ".join(f"{r6(v)} as {k}" for k, v in CYCLIC.items())
    + " from hourly",
)
def _cyclic(spark, sf):
    return hourly(spark, sf).select(
        "datetime", *[round6(c).alias(n) for n, c in cal.cyclic_columns().items()]
    )


HIGH = {
    c: f"cast({c} > (select quantile_cont({c}, 0.8) from hourly) as tinyint)" for c in ("temp", "hum")
}


@query(
    "f12_percentile_flags",
    f"with {HOURLY_CTE} select datetime, {HIGH['temp']} as is_high_temp, {HIGH['hum']} as is_high_hum from hourly",
)
def _high(spark, sf):
    df = hourly(spark, sf)
    return df.select("datetime", *[c.alias(n) for n, c in ft.high_flags(ft.fit_thresholds(df)).items()])


FLAGS = {
    "is_peak_hour": "7,8,9,16,17,18",
    "is_working_hour": "9,10,11,12,13,14,15,16,17",
    "is_business_hour": "8,9,10,11,12,13,14,15,16,17,18,19,20",
}


@query(
    "f13_hour_flags",
    f"with {HOURLY_CTE} select datetime, "
    + ", ".join(f"cast(hr in ({v}) as tinyint) as {k}" for k, v in FLAGS.items())
    + " from hourly",
)
def _hour_flags(spark, sf):
    return hourly(spark, sf).select("datetime", *[c.alias(n) for n, c in ft.hour_flags().items()])


@query(
    "p14_interactions",
    f"""with {HOURLY_CTE} select datetime, temp+hum as temp_plus_hum, hum+hr as hum_plus_hr,
    temp*hum as temp_times_hum from hourly""",
)
def _inter(spark, sf):
    return hourly(spark, sf).select(
        "datetime",
        interaction("temp", "hum", "add"),
        interaction("hum", "hr", "add"),
        interaction("temp", "hum", "multiply"),
    )


def features_sql(cfg: FeatureConfig, key: str | None = None) -> str:
    """SQL of the whole feature table; fractional columns rounded to 6 dp.

    ``key``: a series for each value of this expression over ``events``.
    """
    if key:
        return keyed_sql(features_sql(cfg), key)
    lags = {f"{f.feature}_lag_{k}hr": f"lag({f.feature},{k}) over {H_W}" for f in cfg.lag_features for k in f.lags}
    rolls = {}
    for f in cfg.rolling_features:
        for w in f.windows:
            rolls[f"{f.feature}_rolling_mean_{w}hr"] = roll_sql(f.feature, H_W, w, "avg")
            rolls[f"{f.feature}_rolling_median_{w}hr"] = roll_sql(f.feature, H_W, w, "median")
    diffs = {
        f"{f.feature}_diff_{k}hr": f"{f.feature} - lag({f.feature},{k}) over {H_W}"
        for f in cfg.diff_features
        for k in f.diffs
    }
    inter = {
        f"{i.feature_1}_{'plus' if i.operation == 'add' else 'times'}_{i.feature_2}": f"{i.feature_1}"
        f"{'+' if i.operation == 'add' else '*'}{i.feature_2}"
        for i in cfg.interaction_features
    }
    flags = {
        "is_weekend": "cast(weekday in (5,6) as tinyint)",
        "is_high_temp": HIGH["temp"],
        "is_high_hum": HIGH["hum"],
        **{k: f"cast(hr in ({v}) as tinyint)" for k, v in FLAGS.items()},
    }
    made = {**flags, **CYCLIC, **lags, **rolls, **inter, **diffs}
    kept = ["season", "mnth", "hr", "holiday", "weekday", "workingday", "weathersit", "temp", "hum"]
    back = "over (order by datetime rows between current row and unbounded following)"
    real = {"temp", "hum", *CYCLIC, *rolls, *inter, *[k for k in {**lags, **diffs} if k.startswith(("temp", "hum"))]}

    def out(c: str) -> str:
        x = f"first_value({c} ignore nulls) {back}"
        return f"{r6(x) if c in real else x} as {c}"

    return f"""with {HOURLY_CTE},
    a as (select *, {", ".join(f"{v} as {k}" for k, v in made.items())}, lead(cnt) over {H_W} as nxt from hourly),
    b as (select *, last_value(nxt ignore nulls) over (order by datetime rows unbounded preceding) as target from a)
    select datetime, {", ".join(out(c) for c in [*kept, *made, "target"])} from b"""


def _features(spark, sf, cfg: FeatureConfig):
    df = ft.build_features(hourly(spark, sf), HOURLY, cfg, keep=["datetime"])
    return df.select(
        *[
            round6(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def keyed_sql(sql: str, key: str) -> str:
    """A query over ``hourly`` as one over hours of each ``key``."""
    for old, new in (
        ("date_trunc('hour', ts) as dt, count(*)", f"date_trunc('hour', ts) as dt, {key} as key, count(*)"),
        ("from events group by 1)", "from events group by 1, 2)"),
        ("select cast(dt as timestamp) as datetime", "select key, cast(dt as timestamp) as datetime"),
        ("(order by datetime", "(partition by key order by datetime"),
        ("select datetime,", "select key, datetime,"),
    ):
        sql = sql.replace(old, new)
    return sql


HOT_KEY = "case when user_id % 3 = 0 then 0 else user_id end"
BY_USER = SeriesSpec(("datetime",), ("key",))
BY_HOT_USER = SeriesSpec(("datetime",), ("key",), max_rows=500)


def _features_by(spark, sf, key: str, spec: SeriesSpec, cfg: FeatureConfig):
    df = ft.build_features(hourly(spark, sf, key), spec, cfg, keep=["datetime"])
    return df.select(
        *[round6(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )


@query("f14_features_by_user", features_sql(FeatureConfig(), "user_id"))
def _f14_by_user(spark, sf):
    return _features_by(spark, sf, "user_id", BY_USER, FeatureConfig())


@query("f14_features_hot_user", features_sql(FeatureConfig(), HOT_KEY))
def _f14_hot_user(spark, sf):
    """A third of the users are one key: the automatic layout cuts it into chunks."""
    return _features_by(spark, sf, HOT_KEY, BY_HOT_USER, FeatureConfig())


@query("f18_features_extended_by_user", features_sql(ft.extended_config(), "user_id"))
def _f18_by_user(spark, sf):
    return _features_by(spark, sf, "user_id", BY_USER, ft.extended_config())


@query(
    "f17_naive_forecast_by_user",
    keyed_sql(
        f"""with {HOURLY_CTE} select datetime, cnt as y, coalesce(lag(cnt, 1) over {H_W}, first_value(cnt) over {H_W}) as yhat from hourly""",
        "user_id",
    ),
)
def _naive_by_user(spark, sf):
    df = st.naive_forecast(hourly(spark, sf, "user_id"), "cnt", BY_USER)
    return df.select("key", "datetime", F.col("cnt").alias("y"), "yhat")


@query("f14_features", features_sql(FeatureConfig()))
def _f14(spark, sf):
    return _features(spark, sf, FeatureConfig())


@query("f18_features_extended", features_sql(ft.extended_config()))
def _f18(spark, sf):
    return _features(spark, sf, ft.extended_config())


AUTOCORR_SQL = f"""
  {HOURLY_CTE},
  lags as (select cast(unnest(range(1, 25)) as integer) as lag),
  x as (select cast(cnt as double) as v, row_number() over {H_W} as i from hourly),
  ac as (select lag, {r6("corr(a.v, b.v)")} as autocorrelation
    from lags join x a on true join x b on b.i = a.i - lags.lag group by lag)"""


@query("f15_autocorrelation", f"with {AUTOCORR_SQL} select * from ac")
def _autocorr(spark, sf):
    out = st.autocorrelation(hourly(spark, sf), "cnt", HOURLY, 24)
    return out.select("lag", round6(F.col("autocorrelation")).alias("autocorrelation"))


@query(
    "f15_autocorrelation_single_series",
    f"""with lags as (select cast(unnest(range(1, 25)) as integer) as lag),
    x as (select l_quantity as v, row_number() over {LI_U} as i from lineitem)
    select lag, {r6("corr(a.v, b.v)")} as autocorrelation
    from lags join x a on true join x b on b.i = a.i - lags.lag group by lag""",
)
def _autocorr_chunked(spark, sf):
    out = st.autocorrelation(_li(spark, sf, "l_quantity"), "l_quantity", LI_SINGLE, 24)
    return out.select("lag", round6(F.col("autocorrelation")).alias("autocorrelation"))


@query(
    "f16_top_autocorrelation",
    f"with {AUTOCORR_SQL} select * from ac order by coalesce(autocorrelation, -1) desc, lag limit 10",
)
def _autocorr_top(spark, sf):
    out = st.autocorrelation(hourly(spark, sf), "cnt", HOURLY, 24)
    out = out.select("lag", round6(F.col("autocorrelation")).alias("autocorrelation"))
    return st.top_autocorrelation(out, 10)


@query(
    "f17_naive_forecast",
    f"""with {HOURLY_CTE} select datetime, cnt as y, coalesce(lag(cnt, 1) over {H_W},
    first_value(cnt) over {H_W}) as yhat from hourly""",
)
def _naive(spark, sf):
    df = st.naive_forecast(hourly(spark, sf), "cnt", HOURLY)
    return df.select("datetime", F.col("cnt").alias("y"), "yhat")
