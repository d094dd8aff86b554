"""Table profile: schema, nulls, duplicates, size, numeric and categorical summaries.

A table's numeric columns are counted by value in one scan, whose shuffle key contains the
value; moments, quantiles, modes, distinct and outlier counts all come from those counts. Reports
are a few rows per column; no table row reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions.numeric import round2
from demandspark.operators import columns as sel
from demandspark.operators.quantiles import count_quantiles, top_values, value_counts
from demandspark.session import materialize

TOP_MODES = 5
TOP_VALUES = 10

# A check maps a table to rows (column, metric, value, text).
Check = Callable[[DataFrame], DataFrame]


def _rows(df: DataFrame, entries: list[Column]) -> DataFrame:
    """One output row per struct, from a one-row frame."""
    return df.select(F.inline(F.array(*entries)))


# -- schema and info ------------------------------------------------------------------


def schema_rows(df: DataFrame) -> DataFrame:
    """(column, type_class, type) of the numeric and string columns."""
    rows = [
        (f.name, "numeric" if isinstance(f.dataType, T.NumericType) else "categorical", f.dataType.simpleString())
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.StringType))
    ]
    return df.sparkSession.createDataFrame(rows, "column string, type_class string, type string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(sel.numeric_columns(df))).cast("bigint").alias("number_of_numeric_columns"),
        F.lit(len(sel.string_columns(df))).cast("bigint").alias("number_of_categorical_columns"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _rows(
        counted, [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    )


def total_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("nulls").alias("total_nulls"))


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, unique_values) of numeric and string columns; null is one value."""
    cols = sel.numeric_columns(df) + sel.string_columns(df)
    if approximate:
        counted = df.agg(
            *[
                (F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("bigint").alias(c)
                for c in cols
            ]
        )
        entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("unique_values")) for c in cols]
        return _rows(counted, entries)
    parts = []
    for names, dtype in ((sel.numeric_columns(df), "double"), (sel.string_columns(df), "string")):
        if names:
            counts = value_counts(df, names, dtype)
            parts.append(counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values")))
    return sel.stack(parts)




def duplicated_rows(df: DataFrame, mode: str = "all") -> DataFrame:
    """Rows in groups of equal rows (``all``), or only those after the first (``extra``).

    Equal rows are combined in every task before the one shuffle, so a row that fills half
    of the table reaches its task as one count from each other task.
    """
    if mode not in ("all", "extra"):
        raise ValueError("mode must be 'all' or 'extra'")
    groups = df.groupBy(*df.columns).count().where(F.col("count") > 1)
    n = F.sum("count") if mode == "all" else F.sum(F.col("count") - 1)
    return groups.agg(F.coalesce(n, F.lit(0)).alias("num_duplicated_rows"))


_WIDTH = {
    "tinyint": 1,
    "boolean": 1,
    "smallint": 2,
    "int": 4,
    "float": 4,
    "date": 4,
    "bigint": 8,
    "double": 8,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def table_size(df: DataFrame) -> DataFrame:
    """Estimated size in MB (2 dp) from type widths and string lengths."""
    fixed = sum(_WIDTH.get(f.dataType.simpleString(), 8) for f in df.schema.fields if not isinstance(f.dataType, T.StringType))
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in sel.string_columns(df)]
    total = F.count(F.lit(1)) * F.lit(fixed)
    for t in text:
        total = total + t
    return df.agg(round2(total / F.lit(1048576.0)).alias("memory_usage_MB"))


# -- summaries ------------------------------------------------------------------------


def modes(counts: DataFrame) -> DataFrame:
    """(column, mode): the non-null values of top frequency, ascending, at most five."""
    top = top_values(counts.where(F.col("value").isNotNull()), TOP_MODES)
    listed = top.groupBy("column").agg(
        F.max("n").alias("__m"),
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("__l"),  # five rows
    )
    keep = F.filter("__l", lambda x: x["n"] == F.col("__m"))
    return listed.select("column", F.transform(keep, lambda x: x["value"]).alias("mode"))


@dataclass(frozen=True)
class Facts:
    """What is known of one column: plain numbers, None where there is no value."""

    rows: int
    count: int
    unique: int
    low: float | None
    high: float | None
    mean: float | None
    variance: float | None
    skewness: float | None
    kurtosis: float | None
    quantiles: dict[str, float | None]

    @property
    def std(self) -> float | None:
        return None if self.variance is None else math.sqrt(self.variance)


def column_facts(counts: DataFrame, wanted: dict[str, tuple[float, str]]) -> dict[str, Facts]:
    """Facts by column from value counts that are cheap to read, in three passes over them.

    Moments are sums about the mean, which the first pass gives.
    """
    n, v = F.col("n"), F.col("value")
    first = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.sum(n * v).alias("total"),
    )
    basics = {r["column"]: r for r in first.collect()}
    means = {c: r["total"] / r["count"] if r["count"] else None for c, r in basics.items()}
    known = [x for c, m in means.items() if m is not None for x in (F.lit(c), F.lit(m))]
    d = v - (F.create_map(*known)[F.col("column")] if known else F.lit(None))
    powers = counts.groupBy("column").agg(*[F.sum(n * F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])
    moments = {r["column"]: r for r in powers.collect()}
    found = {r["column"]: r for r in count_quantiles(counts, wanted).collect()}
    out = {}
    for c, r in basics.items():
        count, (m2, m3, m4) = r["count"], (moments[c][f"m{k}"] for k in (2, 3, 4))
        spread = count > 0 and m2 != 0
        out[c] = Facts(
            r["rows"], count, r["unique"], r["low"], r["high"], means[c], m2 / (count - 1) if count > 1 else None,
            math.sqrt(count) * m3 / math.sqrt(m2 * m2 * m2) if spread else None, count * m4 / (m2 * m2) - 3.0 if spread else None,
            {name: found[c][name] if c in found else None for name in wanted},
        )
    return out


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, min, max, mean, std) of numeric columns, unrounded, in one scan of the table.

    Whole numbers are summed exactly, so a large table's mean does not drift.
    """
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}

    def mean(c: str) -> Column:
        if c in whole:
            return F.sum(F.col(c).cast("decimal(38,0)")).cast("double") / F.count(c)
        return F.avg(F.col(c).cast("double"))

    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            mean(c).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("std"),
        ).alias(f"m{i}")
        for i, c in enumerate(cols)
    ]
    return df.agg(*parts).select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(cols))])))


MEDIAN = {"median": (0.5, "linear")}


def numeric_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of numeric columns, written once."""
    return materialize(value_counts(df, cols))


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column; ``missing_pct`` is a fraction here. Empty table: no rows."""
    cols = sel.pick(sel.numeric_columns(df), cols)
    if not cols:
        return df.sparkSession.createDataFrame([], _NUMERIC_SCHEMA)
    counts = numeric_counts(df, cols)
    return summary_rows(counts, column_facts(counts, MEDIAN))


def summary_rows(counts: DataFrame, facts: dict[str, Facts], shape: bool = False) -> DataFrame:
    """The summary from value counts and facts; ``shape`` adds skewness and (excess) kurtosis."""
    rows = [
        (c, f.rows, f.count, f.unique, f.low, f.high, f.mean, f.quantiles["median"], f.std, f.variance, f.skewness, f.kurtosis) for c, f in facts.items()
    ]
    names = ("rows bigint", "count bigint", "unique_values bigint", *(f"{n} double" for n in ("min", "max", "mean", "median", "std", "variance", "skewness", "kurtosis")))
    base = counts.sparkSession.createDataFrame(rows, "column string, " + ", ".join(names))
    missing = F.col("rows") - F.col("count")
    # Both sides have one row per column.
    out = base.join(F.broadcast(modes(counts)), "column", "left")
    return out.select(
        "column",
        round2(F.col("mean")).alias("mean"),
        round2(F.col("median")).alias("median"),
        F.coalesce("mode", F.array().cast("array<double>")).alias("mode"),
        round2(F.col("std")).alias("std"),
        round2(F.col("variance")).alias("variance"),
        round2(F.col("max") - F.col("min")).alias("range"),
        "min",
        "max",
        "count",
        missing.alias("missing_values"),
        round2(missing / F.col("rows")).alias("missing_pct"),
        "unique_values",
        *([round2(F.col(c)).alias(c) for c in ("skewness", "kurtosis")] if shape else []),
    )


_NUMERIC_SCHEMA = (
    "column string, mean double, median double, mode array<double>, std double, variance double, range double, "
    "min double, max double, count bigint, missing_values bigint, missing_pct double, unique_values bigint"
)
_CATEGORICAL_SCHEMA = (
    "column string, total_count bigint, unique_values bigint, missing_values bigint, missing_pct double, entropy double"
)


def categorical_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return value_counts(df, cols, "string")


def categorical_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Counts, distinct values, missing share (percent) and base-10 entropy per column."""
    cols = sel.pick(sel.string_columns(df) + sel.boolean_columns(df), cols)
    if not cols:
        return df.sparkSession.createDataFrame([], _CATEGORICAL_SCHEMA)
    return _categorical_stats(categorical_counts(df, cols))


def _categorical_stats(counts: DataFrame) -> DataFrame:
    n = F.when(F.col("value").isNotNull(), F.col("n"))
    agg = counts.groupBy("column").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_count"),
        F.count(F.lit(1)).alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_values"),
        F.sum(n * F.log10(n)).alias("__nlogn"),
    )
    total = F.col("total_count")
    # H = log10(N) - sum(n log10 n) / N: one pass, no join back to the counts.
    entropy = F.when(total > 0, F.log10(total) - F.col("__nlogn") / total).otherwise(F.lit(0.0))
    return agg.select(
        "column",
        "total_count",
        "unique_values",
        "missing_values",
        round2(F.col("missing_values") / (total + F.col("missing_values")) * F.lit(100.0)).alias("missing_pct"),
        round2(entropy).alias("entropy"),
    )


def categorical_top(df: DataFrame, cols: Sequence[str] | None = None, limit: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, n): most frequent values, ties by value."""
    cols = sel.pick(sel.string_columns(df), cols)
    return top_values(categorical_counts(df, cols), limit).select("column", "rank", "value", "n")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Statistics per string column with its top ten (value, count) list."""
    cols = sel.pick(sel.string_columns(df), cols)
    if not cols:
        schema = _CATEGORICAL_SCHEMA.replace(", entropy double", "") + ", value_counts array<struct<value:string,n:bigint>>"
        return df.sparkSession.createDataFrame([], schema)
    counts = categorical_counts(df, cols)
    top = top_values(counts, TOP_VALUES).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("__l")  # ten rows
    )
    stats = _categorical_stats(counts).drop("entropy")
    return stats.join(F.broadcast(top), "column").select(
        *stats.columns, F.transform("__l", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("value_counts")
    )


# -- full profile -----------------------------------------------------------------------


def _metric(df: DataFrame, column: str | Column, metrics: Sequence[str]) -> DataFrame:
    col = F.col(column) if isinstance(column, str) else column
    entries = [
        F.struct(
            col.alias("column"),
            F.lit(m).alias("metric"),
            F.col(m).cast("double").alias("value"),
            F.lit(None).cast("string").alias("text"),
        )
        for m in metrics
    ]
    return df.select(F.inline(F.array(*entries)))


def check_schema(df: DataFrame) -> DataFrame:
    return schema_rows(df).select(
        "column", F.lit("type").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("type").alias("text")
    )


def check_shape(df: DataFrame) -> DataFrame:
    s = shape(df)
    return _metric(s, F.lit("*"), s.columns)


def check_nulls(df: DataFrame) -> DataFrame:
    per = null_counts(df)
    total = per.agg(F.sum("nulls").alias("total_nulls"))
    return _metric(per, "column", ["nulls"]).unionByName(_metric(total, F.lit("*"), ["total_nulls"]))


def check_duplicates(df: DataFrame) -> DataFrame:
    return _metric(duplicated_rows(df), F.lit("*"), ["num_duplicated_rows"])


def check_size(df: DataFrame) -> DataFrame:
    return _metric(table_size(df), F.lit("*"), ["memory_usage_MB"])


NUMERIC_METRICS = [
    "mean",
    "median",
    "std",
    "variance",
    "range",
    "min",
    "max",
    "count",
    "missing_values",
    "missing_pct",
    "unique_values",
]


def check_numeric(df: DataFrame) -> DataFrame:
    return _metric(numeric_summary(df), "column", NUMERIC_METRICS)


def check_categorical(df: DataFrame) -> DataFrame:
    return _metric(
        categorical_summary(df), "column", ["total_count", "unique_values", "missing_values", "missing_pct"]
    )


DEFAULT_CHECKS: list[Check] = [
    check_schema,
    check_shape,
    check_nulls,
    check_duplicates,
    check_size,
    check_numeric,
    check_categorical,
]


def profile(df: DataFrame, checks: Sequence[Check] | None = None) -> DataFrame:
    """Long profile (column, metric, value, text); ``checks`` may hold own functions."""
    return sel.stack([check(df) for check in (checks or DEFAULT_CHECKS)])


def report(df: DataFrame) -> DataFrame:
    """The nested profile as one row: schema, shape, summaries, info."""

    def one(section: DataFrame, name: str, value: Column) -> DataFrame:
        return section.agg(value.alias(name))

    types = schema_rows(df)

    def type_map(kind: str) -> Column:
        pair = F.when(F.col("type_class") == kind, F.struct("column", "type"))
        return F.map_from_entries(F.collect_list(pair))  # one entry per column

    uniq = cardinality(df).join(F.broadcast(types), "column")

    def unique_map(kind: str) -> Column:
        pair = F.when(F.col("type_class") == kind, F.struct("column", "unique_values"))
        return F.map_from_entries(F.collect_list(pair))

    sections = [
        types.agg(type_map("numeric").alias("numeric_types"), type_map("categorical").alias("string_types")),
        shape(df).select(F.struct("*").alias("data_shape")),
        one(numeric_summary(df), "numeric", F.sort_array(F.collect_list(F.struct("*")))),
        one(categorical_summary(df), "categorical", F.sort_array(F.collect_list(F.struct("*")))),
        uniq.agg(unique_map("numeric").alias("u_numeric"), unique_map("categorical").alias("u_string")),
        null_counts(df).agg(
            F.map_from_entries(F.collect_list(F.struct("column", "nulls"))).alias("data_nulls"),
            F.sum("nulls").alias("total_nulls"),
        ),
        duplicated_rows(df),
        table_size(df),
    ]
    # Every section is one row: stack them and keep the only value of each column.
    rows = sel.stack(sections)
    merged = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
    return merged.select(
        F.struct(F.col("numeric_types").alias("numeric"), F.col("string_types").alias("categorical")).alias("data_schema"),
        "data_shape",
        F.struct("numeric", "categorical").alias("summary_statistics"),
        F.struct(
            F.col("u_numeric").alias("num_unique_numeric_rows"),
            F.col("u_string").alias("num_unique_categorical_rows"),
            "data_nulls",
            "total_nulls",
            "num_duplicated_rows",
            "memory_usage_MB",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("validation_timestamp"),
        ).alias("other_info"),
    )
