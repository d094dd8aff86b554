"""Sources, projections, calendar and split queries, each against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.catalog.base import EVENTS, HOURLY, HOURLY_CTE, hourly, query, r2, table
from demandspark.functions import calendar as cal
from demandspark.functions.numeric import above_flag, clip, membership_flag, round2
from demandspark.functions.pricing import COMPETITOR_INPUTS
from demandspark.operators import calendar as kal
from demandspark.operators import split as sp
from demandspark.operators.ordered import SeriesSpec
from demandspark.plans.features import drop_columns
from demandspark.session import scratch_path
from demandspark.sources import contract, io

H_W = "(order by datetime)"
HOUR_COLS = (
    "datetime, season, yr, mnth, hr, holiday, weekday, workingday, weathersit, temp, atemp, hum, "
    "windspeed, casual, registered, cnt"
)


@query("k06_hourly_demand", f"with {HOURLY_CTE} select {HOUR_COLS} from hourly")
def _hourly(spark, sf):
    return hourly(spark, sf)


@query(
    "k06_hourly_by_key",
    """select event_type, date_trunc('hour', ts)::timestamp as datetime, count(*) as cnt,
    cast(sum(user_id) as bigint) as users_sum from events group by 1, 2""",
)
def _hourly_key(spark, sf):
    aggs = {"cnt": F.count(F.lit(1)), "users_sum": F.sum("user_id")}
    return kal.hourly_totals(table(spark, sf, "events"), "ts", aggs, ["event_type"])


SPINE_SQL = """span as (select event_type, min(ts) as a, max(ts) as b from events group by 1),
  spine as (select event_type, unnest(generate_series(date_trunc('day', a)::timestamp,
    date_trunc('day', b)::timestamp + interval 23 hour, interval 1 hour)) as datetime from span)"""


@query("k01_hourly_spine", f"with {SPINE_SQL} select event_type, datetime from spine")
def _spine(spark, sf):
    return kal.hourly_spine(table(spark, sf, "events"), "ts", ["event_type"])


@query(
    "k05_gap_fill",
    f"""with {SPINE_SQL}, h as (select event_type, date_trunc('hour', ts)::timestamp as datetime, count(*) as cnt
      from events group by 1, 2)
    select event_type, datetime, coalesce(cnt, 0) as cnt from spine left join h using (event_type, datetime)""",
)
def _gaps(spark, sf):
    ev = table(spark, sf, "events")
    h = kal.hourly_totals(ev, "ts", {"cnt": F.count(F.lit(1))}, ["event_type"])
    return kal.fill_hours(h, kal.hourly_spine(ev, "ts", ["event_type"]), {"cnt": 0}, ["event_type"])


CALENDAR_SQL = """cast(case when month(d) in (3,4,5) then 1 when month(d) in (6,7,8) then 2
    when month(d) in (9,10,11) then 3 else 4 end as bigint) as season,
  cast(year(d)-2011 as bigint) as yr, cast(month(d) as bigint) as mnth, cast(hour(d) as bigint) as hr,
  cast(isodow(d)-1 as bigint) as weekday"""


@query("k02_calendar", f"select o_orderkey, {CALENDAR_SQL} from (select *, o_orderdate::timestamp as d from orders)")
def _calendar(spark, sf):
    cols = cal.calendar_columns(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in cols.items()])


# Holidays of the order years, built from the same published rules but as a date table.
HOLIDAY_SQL = """
days as (select unnest(generate_series(date '1990-01-01', date '2003-12-31', interval 1 day))::date as d),
fixed as (select d from days where (month(d), day(d)) in ((1,1),(7,4),(11,11),(12,25))),
observed as (select d - 1 as d from fixed where isodow(d) = 6 union select d + 1 from fixed where isodow(d) = 7),
mondays as (select d from days where isodow(d) = 1 and (
    (month(d) = 1 and day(d) between 15 and 21) or (month(d) = 2 and day(d) between 15 and 21)
    or (month(d) = 5 and day(d) >= 25) or (month(d) = 9 and day(d) <= 7)
    or (month(d) = 10 and day(d) between 8 and 14))),
thanks as (select d from days where isodow(d) = 4 and month(d) = 11 and day(d) between 22 and 28),
hol as (select d from fixed union select d from observed union select d from mondays union select d from thanks)"""


@query(
    "k03_holiday_workday",
    f"""with {HOLIDAY_SQL}, o as (select o_orderkey, o_orderdate::date as d from orders)
    select o_orderkey, cast(case when h.d is not null then 1 else 0 end as bigint) as holiday,
      cast(case when isodow(o.d) < 6 and h.d is null then 1 else 0 end as bigint) as workingday
    from o left join hol h on o.d = h.d""",
)
def _holiday(spark, sf):
    df = kal.add_calendar(table(spark, sf, "orders"), "o_orderdate")
    return df.select("o_orderkey", "holiday", "workingday")


@query(
    "k03_holidays_per_year",
    f"""with {HOLIDAY_SQL}, y as (select distinct o_orderdate::date as d from orders)
    select cast(year(d) as integer) as year, count(*) as holidays from y join hol using (d) group by 1""",
)
def _holidays(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return (
        days.where(cal.holiday_name(F.col("d")).isNotNull())
        .groupBy(F.year("d").alias("year"))
        .agg(F.count(F.lit(1)).alias("holidays"))
    )


# -- sources ------------------------------------------------------------------------------


@query("s01_parquet_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 200000")
def _scan(spark, sf):
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
    return io.read_parquet(spark, f"{sf}/orders.parquet", schema).where(F.col("o_totalprice") > 200000)


@query(
    "s02_records",
    """select event_id, cast(case when props like '{%' then json_extract_string(props, '$.k') end as varchar) as k,
    length(props) as n from events""",
)
def _records(spark, sf):
    """JSON records of a text column, read with a fixed schema."""
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        F.from_json("props", "k string")["k"].alias("k"),
        F.length("props").cast("bigint").alias("n"),
    )


TYPED_TEXT = """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as datetime,
  case when event_id % 50 = 0 then 'bad' else cast(user_id as varchar) end as cnt,
  cast(event_id % 100 as varchar) as temp from events"""


@query(
    "s08_typed_load",
    f"""with t as ({TYPED_TEXT}) select event_id, strptime(datetime, '%Y-%m-%d %H:%M:%S') as datetime,
    coalesce(try_cast(cnt as bigint), -1) as cnt, try_cast(temp as double) as temp, try_cast(cnt as bigint) is null as rejected from t""",
)
def _typed(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.when(F.col("event_id") % 50 == 0, F.lit("bad")).otherwise(F.col("user_id").cast("string")).alias("cnt"),
        (F.col("event_id") % 100).cast("string").alias("temp"),
    )
    out = io.typed(text, {"datetime": "timestamp", "cnt": "bigint", "temp": "double"})
    cnt = F.coalesce("cnt", F.lit(-1)).cast("bigint").alias("cnt")
    return out.select("event_id", "datetime", cnt, "temp", (F.size("bad_columns") > 0).alias("rejected"))


REQUEST_SQL = """req as (select event_id, cast(event_id % 6 as bigint) as season, cast(user_id % 14 as bigint) as mnth,
  cast(event_id % 3 as bigint) as holiday, cast(event_id % 25 as bigint) as hr, cast(user_id % 8 as bigint) as weekday,
  cast(event_id % 2 as bigint) as workingday, cast(user_id % 6 as bigint) as weathersit,
  cast(event_id % 111 as double)/100e0 as temp, cast(event_id % 103 as double)/100e0 as hum,
  cast(user_id % 107 as double)/100e0 as windspeed, cast(event_id % 40 - 1 as bigint) as cnt,
  case when event_id % 7 = 0 then 'EUR' when event_id % 2 = 0 then 'USD' else 'NGN' end as currency from events)"""
BOUND_SQL = " ".join(
    f"|| case when {c} < {lo} or {c} > {hi} then '{c},' else '' end"
    if hi is not None
    else f"|| case when {c} < {lo} then '{c},' else '' end"
    for c, (lo, hi) in contract.BOUNDS.items()
)


@query(
    "s09_input_contract",
    f"""with {REQUEST_SQL}, v as (select event_id, '' {BOUND_SQL}
      || case when currency not in ('NGN','USD') then 'currency,' else '' end as violations from req)
    select event_id, violations, violations = '' as valid from v""",
)
def _contract(spark, sf):
    ev = table(spark, sf, "events")
    e, u = F.col("event_id"), F.col("user_id")
    req = ev.select(
        "event_id",
        (e % 6).alias("season"),
        (u % 14).alias("mnth"),
        (e % 3).alias("holiday"),
        (e % 25).alias("hr"),
        (u % 8).alias("weekday"),
        (e % 2).alias("workingday"),
        (u % 6).alias("weathersit"),
        ((e % 111) / F.lit(100.0)).alias("temp"),
        ((e % 103) / F.lit(100.0)).alias("hum"),
        ((u % 107) / F.lit(100.0)).alias("windspeed"),
        (e % 40 - 1).alias("cnt"),
        F.when(e % 7 == 0, "EUR").when(e % 2 == 0, "USD").otherwise("NGN").alias("currency"),
    )
    out = contract.check(req)
    text = F.concat_ws("", F.transform("violations", lambda v: F.concat(v, F.lit(","))))
    return out.select("event_id", text.alias("violations"), (F.size("violations") == 0).alias("valid"))


@query(
    "s10_input_rounding",
    f"with {HOURLY_CTE} select datetime, {r2('temp')} as temp, {r2('hum')} as hum, {r2('windspeed')} as windspeed from hourly",
)
def _rounding(spark, sf):
    return contract.round_inputs(hourly(spark, sf)).select("datetime", "temp", "hum", "windspeed")


@query(
    "s11_ordered_head",
    "select event_id, ts::timestamp as ts, value from events order by ts, event_id limit 10",
)
def _head(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return io.head(ev, ["ts", "event_id"], 10)


LI_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "s11_describe",
    " union all ".join(
        f"select '{c}' as column, count({c}) as count, cast(min({c}) as double) as min, cast(max({c}) as double) as max, {r2(f'avg({c})')} as mean, {r2(f'stddev_samp({c})')} as std from lineitem"
        for c in LI_NUMBERS
    ),
)
def _describe(spark, sf):
    from demandspark.operators.profile import moments

    li = table(spark, sf, "lineitem")
    out = moments(li, LI_NUMBERS)
    return out.select("column", "count", "min", "max", round2(F.col("mean")).alias("mean"), round2(F.col("std")).alias("std"))


def _round_trip(spark, df, suffix):
    return io.write_table(df, scratch_path(spark, "sink") + suffix)


@query("s04_parquet_sink", "select c_custkey, c_mktsegment, c_acctbal from customer")
def _parquet_sink(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return io.read_parquet(spark, _round_trip(spark, df, ".parquet"), df.schema)


@query("s05_csv_sink", "select c_custkey, c_mktsegment, c_acctbal from customer")
def _csv_sink(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return io.read_csv(spark, _round_trip(spark, df, ".csv"), df.schema)


@query(
    "s07_report_sink",
    """select count(*) as total_rows, 4::bigint as total_columns, 3::bigint as number_of_numeric_columns, 1::bigint as number_of_categorical_columns
    from supplier""",
)
def _report_sink(spark, sf):
    from demandspark.operators.profile import report

    path = scratch_path(spark, "report")
    io.write_report(report(table(spark, sf, "supplier")), path)
    return spark.read.json(path).select("data_shape.*")


# -- projection and filter -------------------------------------------------------------------


@query("p01_select", f"with {HOURLY_CTE} select {', '.join(COMPETITOR_INPUTS)} from hourly")
def _select(spark, sf):
    return hourly(spark, sf).select(*COMPETITOR_INPUTS)


@query(
    "p02_drop",
    f"with {HOURLY_CTE} select season, mnth, hr, holiday, weekday, workingday, weathersit, temp, hum from hourly",
)
def _drop(spark, sf):
    cols = ["atemp", "windspeed", "casual", "registered", "datetime", "cnt", "yr"]
    return drop_columns(hourly(spark, sf), cols)


@query(
    "p05_constant_columns",
    f"with {HOURLY_CTE} select datetime, cnt, 0e0 as atemp, 0e0 as casual, 0e0 as registered from hourly",
)
def _constants(spark, sf):
    from demandspark.plans.scoring import add_missing_inputs

    return add_missing_inputs(hourly(spark, sf).select("datetime", "cnt"))


CODES = ["season", "yr", "mnth", "hr", "holiday", "weekday", "workingday", "weathersit"]


@query(
    "p06_recast_codes",
    f"with {HOURLY_CTE} select datetime, "
    + ", ".join(f"cast({c} as varchar) as {c}" for c in CODES)
    + ", cast(hr as tinyint) as hour_number from hourly",
)
def _recast(spark, sf):
    df = hourly(spark, sf).select("datetime", *[F.col(c).cast("string").alias(c) for c in CODES])
    return df.withColumn("hour_number", F.col("hr").cast("tinyint"))


@query(
    "p07_flags",
    """select l_orderkey, l_linenumber, cast(l_linenumber in (1, 3, 5) as tinyint) as odd_line,
    cast(l_quantity > 30 as tinyint) as large, least(greatest(l_quantity, 10), 40) as clipped from lineitem""",
)
def _flags(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        membership_flag(F.col("l_linenumber"), [1, 3, 5]).alias("odd_line"),
        above_flag(F.col("l_quantity"), 30.0).alias("large"),
        clip(F.col("l_quantity"), 10.0, 40.0).alias("clipped"),
    )


@query("p11_drop_nulls", "select event_id, value from events where case when event_id % 3 = 0 then value end is not null")
def _drop_nulls(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "case when event_id % 3 = 0 then value end as value")
    return df.dropna(subset=["value"])


@query(
    "p12_assemble",
    f"with {HOURLY_CTE} select cast(hr as double) as hr, temp, hum, cast(cnt as double) as target from hourly",
)
def _assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from demandspark.plans.models import assemble

    df = hourly(spark, sf).select("hr", "temp", "hum", F.col("cnt").alias("target"))
    vector = vector_to_array("features")
    return assemble(df, "target").select(*[vector[i].alias(c) for i, c in enumerate(("hr", "temp", "hum"))], "target")


# -- splits -------------------------------------------------------------------------------------

LI_SINGLE = SeriesSpec(("l_shipdate", "l_orderkey", "l_linenumber"), max_rows=9_000, mode="chunked")
LI_W = "(order by l_shipdate, l_orderkey, l_linenumber)"


@query("p09_row_index", f"select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as index from events")
def _index(spark, sf):
    return sp.add_row_index(table(spark, sf, "events"), EVENTS).select("event_id", "index")


@query(
    "p10_row_range",
    f"with {HOURLY_CTE}, i as (select *, row_number() over {H_W} - 1 as index from hourly) select datetime, cnt from i where index > 100 and index <= 300",
)
def _range(spark, sf):
    df = sp.add_row_index(hourly(spark, sf), HOURLY)
    return sp.rows_between(df, 100, 300).select("datetime", "cnt")


def _split_sql(source: str, order: str, cols: str, test: float, val: float) -> str:
    n = f"(select count(*) from {source})"
    train = f"cast(floor(({1 - test - val!r}::double) * {n}) as bigint)"
    v = f"cast(floor(({val!r}::double) * {n}) as bigint)"
    return f"""select {cols}, case when i <= {train} then 'train' when i <= {train} + {v} then 'val' else 'test' end as split
      from (select *, row_number() over {order} - 1 as i from {source})"""


@query("t01_split", f"with {HOURLY_CTE} " + _split_sql("hourly", H_W, "datetime, cnt", 0.1, 0.1))
def _split(spark, sf):
    train, val, test = sp.split_train_val_test(hourly(spark, sf).select("datetime", "cnt"), HOURLY, 0.1, 0.1)
    parts = [p.withColumn("split", F.lit(n)) for n, p in (("train", train), ("val", val), ("test", test))]
    return sp.combine_rows(sp.combine_rows(parts[0], parts[1]), parts[2])


# Every third ship date is missing: nulls come first in series order.
LI_GAPS = "(select l_orderkey, l_linenumber, case when l_orderkey % 3 <> 0 then l_shipdate end as l_shipdate from lineitem)"
LI_GAPS_W = "(order by l_shipdate nulls first, l_orderkey, l_linenumber)"


def _with_gaps(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return li.withColumn("l_shipdate", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_shipdate")))


@query("t01_split_null_times", _split_sql(LI_GAPS, LI_GAPS_W, "l_orderkey, l_linenumber", 0.2, 0.2))
def _split_null_times(spark, sf):
    return sp.label_split(_with_gaps(spark, sf), LI_SINGLE, 0.2, 0.2).select("l_orderkey", "l_linenumber", "split")


@query(
    "t02_two_way_split_null_times",
    f"""select l_orderkey, l_linenumber, case when i < cast(floor((0.25::double) * n) as bigint) then 'train' else 'test' end as split
    from (select *, row_number() over {LI_GAPS_W} - 1 as i, count(*) over () as n from {LI_GAPS})""",
)
def _two_way_null_times(spark, sf):
    return sp.label_two_way(_with_gaps(spark, sf), LI_SINGLE, 0.75).select("l_orderkey", "l_linenumber", "split")


@query("t01_split_large", _split_sql("lineitem", LI_W, "l_orderkey, l_linenumber", 0.2, 0.2))
def _split_large(spark, sf):
    li = table(spark, sf, "lineitem")
    return sp.label_split(li, LI_SINGLE, 0.2, 0.2).select("l_orderkey", "l_linenumber", "split")


@query(
    "t02_two_way_split",
    f"""with {HOURLY_CTE} select datetime, case when i < cast(floor((0.9::double) * (select count(*) from hourly)) as bigint)
    then 'train' else 'test' end as split from (select *, row_number() over {H_W} - 1 as i from hourly)""",
)
def _two_way(spark, sf):
    return sp.label_two_way(hourly(spark, sf).select("datetime"), HOURLY, 0.1)


@query(
    "t03_expanding_folds_large",
    f"""with i as (select l_orderkey, l_linenumber, row_number() over {LI_W} - 1 as index, count(*) over () as n from lineitem),
    f as (select unnest(range(3)) as fold)
    select cast(fold as integer) as fold, case when index < n - (3-fold)*1000 then 'train' else 'test' end as role, l_orderkey, l_linenumber, index
    from i join f on index < n - (3-fold-1)*1000 where n > 3000""",
)
def _folds_large(spark, sf):
    li = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return sp.expanding_folds(li, LI_SINGLE, 3, 1000).drop("l_shipdate")


@query(
    "t03_expanding_folds",
    f"""with {HOURLY_CTE}, i as (select datetime, row_number() over {H_W} - 1 as index, count(*) over () as n from hourly),
    f as (select unnest(range(3)) as fold)
    select cast(fold as integer) as fold, case when index < n - (3-fold)*100 then 'train' else 'test' end as role, datetime, index
    from i join f on index < n - (3-fold-1)*100""",
)
def _folds(spark, sf):
    return sp.expanding_folds(hourly(spark, sf).select("datetime"), HOURLY, 3, 100)


@query(
    "t04_combine",
    """select c_custkey as k, c_acctbal as balance from customer union all select s_suppkey, s_acctbal from supplier""",
)
def _combine(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey as k", "c_acctbal as balance")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_acctbal as balance")
    return sp.combine_rows(a, b)
