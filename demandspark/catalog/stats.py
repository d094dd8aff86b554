"""Profile and exploration queries, each against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.catalog.base import HOURLY_CTE, hourly, query, r, r2, r6, table, wide
from demandspark.functions.numeric import round6, strength_label
from demandspark.operators import explore as ex
from demandspark.operators import profile as pf
from demandspark.operators.quantiles import exact_quantiles

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_NUM]
EV_NUM = ["user_id", "value"]
CU_STR = ["c_name", "c_mktsegment"]


def union(parts) -> str:
    return " union all ".join(parts)


def _cols(df, names):
    return df.select(*names)


# -- profile ------------------------------------------------------------------------------

EV_SPARSE = "(select user_id, case when event_id % 3 = 0 then value end as value, event_type, props from events)"


def _ev_sparse(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "user_id", "case when event_id % 3 = 0 then value end as value", "event_type", "props"
    )


@query(
    "v03_cardinality",
    union(
        f"select '{c}' as column, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as unique_values from {EV_SPARSE}"
        for c in ["user_id", "value", "event_type", "props"]
    ),
)
def _card(spark, sf):
    return pf.cardinality(_ev_sparse(spark, sf))


LI_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


@query(
    "v03_cardinality_approximate",
    f"select unnest({LI_COLUMNS}) as column, true as within_15_percent",
)
def _card_approx(spark, sf):
    """The default relative deviation is 5 percent: three of these hold for every column."""
    li = table(spark, sf, "lineitem")
    exact = pf.cardinality(li).withColumnRenamed("unique_values", "exact")
    off = F.abs(F.col("unique_values") - F.col("exact")) / F.col("exact")
    return pf.cardinality(li, approximate=True).join(exact, "column").select("column", (off <= 0.15).alias("within_15_percent"))


@query(
    "v04_null_counts",
    union(
        f"select '{c}' as column, count(*) - count({c}) as nulls from {EV_SPARSE}"
        for c in ["user_id", "value", "event_type", "props"]
    ),
)
def _nulls(spark, sf):
    return pf.null_counts(_ev_sparse(spark, sf))


@query(
    "v05_duplicated_rows",
    """with d as (select l_suppkey, l_linenumber, l_quantity, l_returnflag from lineitem),
    g as (select count(*) as n from d group by l_suppkey, l_linenumber, l_quantity, l_returnflag having count(*) > 1)
    select cast(coalesce(sum(n), 0) as bigint) as num_duplicated_rows from g""",
)
def _dups(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return pf.duplicated_rows(df)


@query(
    "v05_duplicated_rows_extra",
    """select (select count(*) from lineitem) - count(*) as num_duplicated_rows
    from (select distinct l_suppkey, l_linenumber, l_quantity, l_returnflag from lineitem)""",
)
def _dups_extra(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return pf.duplicated_rows(df, "extra")


@query(
    "v06_table_size",
    f"select {r2('(count(*)*28 + sum(octet_length(encode(c_name))) + sum(octet_length(encode(c_mktsegment))))/1048576e0')} as \"memory_usage_MB\""
    " from (select c_custkey, c_nationkey, c_acctbal, c_name, c_mktsegment, cast(c_acctbal as double) as b2 from customer)",
)
def _size(spark, sf):
    df = table(spark, sf, "customer").withColumn("b2", F.col("c_acctbal").cast("double"))
    return pf.table_size(df)


@query(
    "v07_shape",
    """select count(*) as total_rows, cast(5 as bigint) as total_columns, cast(3 as bigint) as number_of_numeric_columns,
    cast(2 as bigint) as number_of_categorical_columns from customer""",
)
def _shape(spark, sf):
    return pf.shape(table(spark, sf, "customer"))


def mode_sql(source: str, c: str, as_list: bool = True) -> str:
    return f"""(select list(v order by v) from (select v from (select cast({c} as double) as v, count(*) as n from {source}
      where {c} is not null group by 1) where n = (select max(n) from (select count(*) as n from {source} where {c} is not null group by {c}))
      order by v limit 5))"""


def numeric_sql(source: str, c: str) -> str:
    x = f"cast({c} as double)"
    return f"""select '{c}' as column, {r2(f'avg({x})')} as mean, {r2(f'median({x})')} as median,
      array_to_string(list_transform({mode_sql(source, c)}, lambda m: cast(cast(floor(m*100+0.5) as bigint) as varchar)), '|') as mode,
      {r2(f'stddev({x})')} as std, {r2(f'variance({x})')} as variance, {r2(f'max({x}) - min({x})')} as range,
      min({x}) as min, max({x}) as max, count({c}) as count, count(*) - count({c}) as missing_values,
      {r2(f'(count(*) - count({c}))/cast(count(*) as double)')} as missing_pct,
      count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as unique_values from {source}"""


def _mode_text(df):
    text = F.array_join(F.transform("mode", lambda m: F.floor(m * 100 + 0.5).cast("bigint").cast("string")), "|")
    return df.withColumn("mode", text)


@query("v08_numeric_summary", union(numeric_sql("lineitem", c) for c in LI_ALL_NUM))
def _numeric(spark, sf):
    return _mode_text(pf.numeric_summary(wide(spark, sf, "lineitem")))


@query("v08_numeric_summary_nulls", union(numeric_sql(EV_SPARSE, c) for c in EV_NUM))
def _numeric_nulls(spark, sf):
    return _mode_text(pf.numeric_summary(_ev_sparse(spark, sf)))


@query(
    "v09_modes",
    union(
        f"select '{c}' as column, cast(unnest({mode_sql('lineitem', c)}) as double) as mode" for c in ["l_quantity", "l_discount", "l_partkey"]
    ),
)
def _modes(spark, sf):
    from demandspark.operators.quantiles import value_counts

    counts = value_counts(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_partkey"])
    return pf.modes(counts).select("column", F.explode("mode").alias("mode"))


def cat_sql(source: str, c: str, entropy: bool = True) -> str:
    h = f"""(select {r2('log10(sum(n)) - sum(n*log10(n))/sum(n)')} from (select count(*)::double as n from {source}
      where {c} is not null group by {c}))"""
    return f"""select '{c}' as column, count({c}) as total_count,
      count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as unique_values,
      count(*) - count({c}) as missing_values,
      {r2(f'(count(*) - count({c}))/cast(count(*) as double)*100e0')} as missing_pct
      {f', coalesce({h}, 0e0) as entropy' if entropy else ''} from {source}"""


EV_CAT = "(select case when event_id % 4 > 0 then event_type end as event_type, props, cast(value > 50 as boolean) as high from events)"


def _ev_cat(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "case when event_id % 4 > 0 then event_type end as event_type", "props", "value > 50 as high"
    )


@query("v10_categorical_summary", union(cat_sql(EV_CAT, c, False) for c in ["event_type", "props"]))
def _categorical(spark, sf):
    return pf.categorical_summary(_ev_cat(spark, sf)).drop("value_counts")


@query(
    "v10_top_values",
    union(
        f"""(select '{c}' as column, cast(row_number() over (order by n desc, value nulls first) as integer) as rank, value, n
        from (select {c} as value, count(*) as n from {EV_CAT} group by 1) order by n desc, value nulls first limit 10)"""
        for c in ["event_type", "props"]
    ),
)
def _top(spark, sf):
    return pf.categorical_top(_ev_cat(spark, sf))


CU_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
CU_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


def _profile_sql() -> str:
    parts = [f"select '{c}' as column, 'type' as metric, null::double as value, '{t}' as text" for c, t in CU_TYPES.items()]
    star = {
        "total_rows": "count(*)",
        "total_columns": "max(5)",
        "number_of_numeric_columns": "max(3)",
        "number_of_categorical_columns": "max(2)",
        "total_nulls": " + ".join(f"(count(*) - count({c}))" for c in CU_TYPES),
        "memory_usage_MB": r2("(count(*)*20 + sum(octet_length(encode(c_name))) + sum(octet_length(encode(c_mktsegment))))/1048576e0"),
    }
    parts += [f"select '*', '{m}', cast({e} as double), null from customer" for m, e in star.items()]
    parts.append(
        "select '*', 'num_duplicated_rows', cast(coalesce(sum(n),0) as double), null from (select count(*) as n from customer group by c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment having count(*) > 1)"
    )
    parts += [f"select '{c}', 'nulls', cast(count(*) - count({c}) as double), null from customer" for c in CU_TYPES]
    for c in CU_NUM:
        for m in pf.NUMERIC_METRICS:
            parts.append(f"select '{c}', '{m}', cast({m} as double), null from ({numeric_sql('customer', c)})")
    for c in CU_STR:
        for m in ["total_count", "unique_values", "missing_values", "missing_pct"]:
            parts.append(f"select '{c}', '{m}', cast({m} as double), null from ({cat_sql('customer', c, False)})")
    return union(parts)


@query("v11_profile", _profile_sql())
def _profile(spark, sf):
    return pf.profile(table(spark, sf, "customer"))


def _report_sql() -> str:
    nums = [f"select 'numeric' as part, '{c}' as column, '{m}' as metric, cast({m} as double) as value from ({numeric_sql('customer', c)})" for c in CU_NUM for m in pf.NUMERIC_METRICS]
    cats = [
        f"select 'categorical', '{c}', '{m}', cast({m} as double) from ({cat_sql('customer', c, False)})"
        for c in CU_STR for m in ["total_count", "unique_values", "missing_values", "missing_pct"]
    ]
    star = {"total_rows": "count(*)", "total_columns": "max(5)", "number_of_numeric_columns": "max(3)", "number_of_categorical_columns": "max(2)"}
    shape = [f"select 'shape', '*', '{m}', cast({e} as double) from customer" for m, e in star.items()]
    nulls = [f"select 'nulls', '{c}', 'nulls', cast(count(*) - count({c}) as double) from customer" for c in CU_TYPES]
    return union([*nums, *cats, *shape, *nulls])


@query("v11_report", _report_sql())
def _report(spark, sf):
    """The nested report, its parts taken apart again."""
    whole = pf.report(table(spark, sf, "customer"))

    def long(part: str, row: str, metrics: list[str]):
        pairs = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(f"r.{m}").cast("double"))])
        each = whole.select(F.explode(f"summary_statistics.{row}").alias("r"))
        return each.select(F.lit(part).alias("part"), F.col("r.column").alias("column"), F.explode(pairs).alias("metric", "value"))

    shape = ["total_rows", "total_columns", "number_of_numeric_columns", "number_of_categorical_columns"]
    pairs = F.create_map(*[x for m in shape for x in (F.lit(m), F.col(f"data_shape.{m}").cast("double"))])
    parts = [
        long("numeric", "numeric", list(pf.NUMERIC_METRICS)),
        long("categorical", "categorical", ["total_count", "unique_values", "missing_values", "missing_pct"]),
        whole.select(F.lit("shape").alias("part"), F.lit("*").alias("column"), F.explode(pairs).alias("metric", "value")),
        whole.select(F.lit("nulls").alias("part"), F.explode(F.col("other_info.data_nulls").cast("map<string,double>")).alias("column", "value"))
        .select("part", "column", F.lit("nulls").alias("metric"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- outliers and summaries -----------------------------------------------------------------


def nearest_sql(source: str, c: str, q: float) -> str:
    return f"""(select v from (select cast({c} as double) as v, row_number() over (order by {c}) - 1 as i,
      count(*) over () as n from {source} where {c} is not null) where i = floor({q}e0*(n-1)+0.5e0))"""


def iqr_sql(source: str, c: str) -> str:
    q1, q3 = nearest_sql(source, c, 0.25), nearest_sql(source, c, 0.75)
    return f"({c} < {q1} - 1.5e0*({q3} - {q1}) or {c} > {q3} + 1.5e0*({q3} - {q1}))"


def z_sql(source: str, c: str) -> str:
    # A constant column has no outliers.
    return f"(abs(({c} - (select avg({c}) from {source}))/(select nullif(stddev({c}), 0) from {source})) > 3)"


@query("e01_iqr_outliers", f"select event_id, value, {iqr_sql('events', 'value')} as is_outlier from events")
def _iqr(spark, sf):
    return ex.flag_outliers(table(spark, sf, "events"), "value", "iqr").select("event_id", "value", "is_outlier")


@query("e02_zscore_outliers", f"select event_id, value, {z_sql('events', 'value')} as is_outlier from events")
def _z(spark, sf):
    return ex.flag_outliers(table(spark, sf, "events"), "value", "zscore").select("event_id", "value", "is_outlier")


def ext_sql(source: str, c: str) -> str:
    x = f"cast({c} as double)"
    m = f"(select avg({x}) from {source})"
    m2, m3 = f"avg(({x}-{m})*({x}-{m}))", f"avg(({x}-{m})*({x}-{m})*({x}-{m}))"
    m4 = f"avg(({x}-{m})*({x}-{m})*({x}-{m})*({x}-{m}))"
    return f"""select '{c}' as column, {r2('q')} as iqr_value, {r2('s')} as skewness, {r2('k')} as kurtosis,
      (select count(*) from {source} where {iqr_sql(source, c)}) as outlier_count_iqr,
      (select count(*) from {source} where {z_sql(source, c)}) as outlier_count_zscore, n as count
      from (select {nearest_sql(source, c, 0.75)} - {nearest_sql(source, c, 0.25)} as q, {m3}/pow({m2}, 1.5) as s,
        {m4}/({m2}*{m2}) - 3 as k, count({c}) as n from {source})"""


@query("e03_numeric_summary", union(ext_sql("lineitem", c) for c in LI_ALL_NUM))
def _summary(spark, sf):
    out = ex.numeric_summary(table(spark, sf, "lineitem"), LI_ALL_NUM)
    return out.select("column", "iqr_value", "skewness", "kurtosis", "outlier_count_iqr", "outlier_count_zscore", "count")


@query("e04_categorical_summary", union(cat_sql(EV_CAT, c) for c in ["event_type", "props", "high"]))
def _cat(spark, sf):
    return ex.categorical_summary(_ev_cat(spark, sf))


@query(
    "e04_category_counts",
    union(f"select '{c}' as column, cast({c} as varchar) as value, count(*) as n from {EV_CAT} group by 2" for c in ["event_type", "props", "high"]),
)
def _cat_counts(spark, sf):
    return ex.category_counts(_ev_cat(spark, sf))


# -- correlations ---------------------------------------------------------------------------


def corr_sql(source: str, cols) -> str:
    return union(
        f"select '{a}' as a, '{b}' as b, {r6(f'corr({a}, {b})') if a != b else 'max(1e0)'} as r from {source}" for a in cols for b in cols
    )


@query("e05_pearson", corr_sql("lineitem", LI_ALL_NUM))
def _pearson(spark, sf):
    return ex.pearson_matrix(wide(spark, sf, "lineitem", *LI_ALL_NUM)).withColumn("r", round6(F.col("r")))


@query(
    "e05_pearson_nulls",
    f"""with s as (select user_id, value, cast(length(props) as bigint) as n from {EV_SPARSE})
    select 'user_id' as a, 'n' as b, {r6('corr(user_id, n)')} as r from s union all select 'n', 'user_id', {r6('corr(user_id, n)')} from s
    union all select 'user_id', 'user_id', 1e0 union all select 'n', 'n', 1e0 union all select 'value', 'value', null
    union all select 'user_id', 'value', null union all select 'value', 'user_id', null
    union all select 'n', 'value', null union all select 'value', 'n', null""",
)
def _pearson_nulls(spark, sf):
    df = _ev_sparse(spark, sf).select("user_id", "value", F.length("props").cast("bigint").alias("n"))
    return ex.pearson_matrix(df).withColumn("r", round6(F.col("r")))


@query(
    "e05_pearson_pairwise",
    f"""with s as {EV_SPARSE} select 'user_id' as a, 'value' as b, {r6('corr(user_id, value)')} as r from s
    union all select 'value', 'user_id', {r6('corr(user_id, value)')} from s union all select 'user_id', 'user_id', 1e0
    union all select 'value', 'value', 1e0""",
)
def _pearson_pair(spark, sf):
    df = _ev_sparse(spark, sf).select("user_id", "value")
    return ex.pearson_matrix(df, nulls="pairwise").withColumn("r", round6(F.col("r")))


def rank_sql(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2e0 as {c}"


@query(
    "e06_spearman",
    f"with k as (select {', '.join(rank_sql(c) for c in LI_ALL_NUM)} from lineitem) " + corr_sql("k", LI_ALL_NUM),
)
def _spearman(spark, sf):
    out = ex.spearman_matrix(table(spark, sf, "lineitem").select(*LI_ALL_NUM))
    return out.withColumn("r", round6(F.col("r")))


@query(
    "e08_target_correlations",
    f"with {HOURLY_CTE} "
    + "select * from ("
    + union(
        f"select '{c}' as feature, {r6(f'corr({c}, cnt)')} as r from hourly"
        for c in ["hr", "weekday", "weathersit", "temp", "hum", "windspeed", "casual"]
    )
    + ") order by r desc",
)
def _target_corr(spark, sf):
    cols = ["hr", "weekday", "weathersit", "temp", "hum", "windspeed", "casual", "cnt"]
    return ex.target_correlations(hourly(spark, sf).select(*cols), "cnt").withColumn("r", round6(F.col("r")))


LABEL_SQL = """case when r > 0 then 'positive' else 'negative' end || '_' || case when abs(r) > 0.7 then 'very_strong'
  when abs(r) > 0.5 then 'strong' when abs(r) > 0.3 then 'moderate' else 'weak' end"""


@query("e09_strength_labels", f"with c as ({corr_sql('lineitem', LI_ALL_NUM)}) select a, b, {LABEL_SQL} as label from c")
def _labels(spark, sf):
    out = ex.pearson_matrix(wide(spark, sf, "lineitem", *LI_ALL_NUM))
    return out.select("a", "b", strength_label(round6(F.col("r"))).alias("label"))


# -- groups -----------------------------------------------------------------------------------


def group_sql(source: str, by: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"count({c}) as {c}_count, {r(f'avg({c})')} as {c}_mean, {r(f'median({c})')} as {c}_median, "
            f"{r(f'stddev({c})')} as {c}_std, min({c}) as {c}_min, max({c}) as {c}_max"
        )
    return f"select {by}, {', '.join(parts)} from {source} group by {by}"


@query("e07_group_analysis", group_sql("lineitem", "l_returnflag", LI_ALL_NUM))
def _groups(spark, sf):
    return ex.group_analysis(table(spark, sf, "lineitem"), "l_returnflag", LI_ALL_NUM)


@query(
    "e07_group_analysis_nulls",
    "with s as (select case when event_id % 4 > 0 then event_type end as event_type, case when event_id % 3 = 0 then value end as value from events) "
    + group_sql("s", "event_type", ["value"]),
)
def _groups_nulls(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "case when event_id % 4 > 0 then event_type end as event_type", "case when event_id % 3 = 0 then value end as value"
    )
    return ex.group_analysis(df, "event_type")


@query(
    "e10_category_share",
    union(
        f"select '{c}' as column, {c} as value, {r('count(*)/cast((select count(*) from lineitem) as double)*100e0', 1)} as share from lineitem group by {c}"
        for c in ["l_returnflag", "l_linestatus"]
    ),
)
def _share(spark, sf):
    return ex.category_share(table(spark, sf, "lineitem"))


def hist_sql(c: str, bins: int) -> str:
    w = f"((b-a)/{bins})"
    return f"""select '{c}' as column, cast(i as integer) as bin, {r6(f'a + i*{w}')} as low, {r6(f'a + (i+1)*{w}')} as high,
      (select count(*) from lineitem where least(floor(({c}-a)/{w}), {bins - 1}) = i) as n
      from (select min({c}) as a, max({c}) as b from lineitem), range({bins}) as t(i)"""


@query("e11_histogram", union(hist_sql(c, 20) for c in ["l_quantity", "l_extendedprice"]))
def _hist(spark, sf):
    out = ex.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 20)
    return out.withColumns({"low": round6(F.col("low")), "high": round6(F.col("high"))})


def box_sql(source: str, c: str, by: str | None = None) -> str:
    q = [f"{r6(f'quantile_cont({c}, {p})')} as {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    head = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return f"select {head}'{c}' as column, cast(min({c}) as double) as min, {', '.join(q)}, cast(max({c}) as double) as max from {source}{tail}"


def _box_round(df):
    return df.withColumns({c: round6(F.col(c)) for c in ("q1", "median", "q3")})


@query("e12_box", union(box_sql("lineitem", c) for c in LI_ALL_NUM))
def _box(spark, sf):
    return _box_round(ex.box_rows(table(spark, sf, "lineitem"), LI_ALL_NUM))


@query("e12_box_by_group", union(box_sql("lineitem", c, "l_returnflag") for c in LI_ALL_NUM))
def _box_group(spark, sf):
    return _box_round(ex.box_rows(table(spark, sf, "lineitem"), LI_ALL_NUM, "l_returnflag"))


@query(
    "e13_outlier_scatter",
    union(
        f"select '{c}' as column, cast({c} as double) as value, {iqr_sql('lineitem', c)} as is_outlier from lineitem where {c} is not null"
        for c in ["l_extendedprice", "l_tax"]
    ),
)
def _scatter(spark, sf):
    return ex.outlier_rows(wide(spark, sf, "lineitem", "l_extendedprice", "l_tax"))


@query(
    "e14_group_means",
    "select l_returnflag, "
    + ", ".join(f"{r6(f'avg({c})')} as {c}" for c in ["l_quantity", "l_extendedprice", "l_linenumber"])
    + " from lineitem group by 1 order by l_quantity desc",
)
def _means(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_linenumber")
    out = ex.group_means(df, "l_returnflag", "l_quantity")
    return out.withColumns({c: round6(F.col(c)) for c in ("l_quantity", "l_extendedprice", "l_linenumber")})


@query("e15_group_points", "select event_type, value, user_id from events")
def _points(spark, sf):
    return ex.group_points(table(spark, sf, "events"), "event_type", "value", size="user_id")


@query("e15_group_points_sample", "select distinct event_type, true as all_from_table, true as share_near_tenth from events")
def _points_sample(spark, sf):
    """Each sampled point is one of the table's; every group keeps about a tenth."""
    ev = table(spark, sf, "events")
    got = ex.group_points(ev, "event_type", "value", fraction=0.1).groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("taken"))
    have = ev.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum("taken") / F.sum("n")
    both = have.join(got, ["event_type", "value"], "full").groupBy("event_type")
    return both.agg(
        F.bool_and(F.coalesce(F.col("taken"), F.lit(0)) <= F.coalesce(F.col("n"), F.lit(0))).alias("all_from_table"),
        share.between(0.05, 0.2).alias("share_near_tenth"),
    )


@query(
    "e16_linear_trend",
    f"""select count(*) as n, {r6('regr_slope(l_extendedprice, l_quantity)')} as slope,
    {r6('regr_intercept(l_extendedprice, l_quantity)')} as intercept, {r6('regr_r2(l_extendedprice, l_quantity)')} as r2 from lineitem""",
)
def _trend(spark, sf):
    out = ex.linear_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.withColumns({c: round6(F.col(c)) for c in ("slope", "intercept", "r2")})


@query(
    "e17_dataset_info",
    """select count(*) as total_rows, cast(6 as bigint) as total_columns, cast(3 as bigint) as numeric_columns,
    cast(2 as bigint) as categorical_columns, cast(0 as bigint) as boolean_columns,
    cast(count(*)*6 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props) as bigint)
      as missing_values_total from events""",
)
def _info(spark, sf):
    return ex.dataset_info(table(spark, sf, "events"))


@query(
    "e20_nearest_quantiles",
    union(
        f"select '{c}' as column, {nearest_sql('lineitem', c, 0.25)} as q25, {nearest_sql('lineitem', c, 0.75)} as q75" for c in LI_ALL_NUM
    ),
)
def _nearest(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), LI_ALL_NUM, [0.25, 0.75], "nearest")
    return spark.createDataFrame([(c, *q[c]) for c in LI_ALL_NUM], "column string, q25 double, q75 double")


@query(
    "e20_quantiles_bracketed",
    union(
        f"select '{c}' as column, {nearest_sql('lineitem', c, 0.25)} as q25, {nearest_sql('lineitem', c, 0.5)} as q50, {nearest_sql('lineitem', c, 0.999)} as q999"
        for c in LI_ALL_NUM
    ),
)
def _bracketed(spark, sf):
    """The path for tables above the task limit: sketch, bracket, count inside."""
    li = table(spark, sf, "lineitem")
    q = exact_quantiles(li, LI_ALL_NUM, [0.25, 0.5, 0.999], "nearest", max_rows=500)
    return spark.createDataFrame([(c, *q[c]) for c in LI_ALL_NUM], "column string, q25 double, q50 double, q999 double")


@query(
    "e21_top_k",
    "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20",
)
def _topk(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ex.top_k(df, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 20)
