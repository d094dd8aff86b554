"""Exploratory statistics and the rows behind charts.

Whole-table statistics that later expressions compare with (bounds, means, bin edges) are
scalars on the driver, a few per column; data rows never are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.numeric import round2, round_half_up
from demandspark.operators import columns as sel
from demandspark.operators import profile as prof
from demandspark.operators.quantiles import (
    exact_quantiles,
    grouped_quantiles,
    ranked_counts,
    value_counts,
)
from demandspark.session import materialize

OUTLIER_METHODS = ("iqr", "zscore")
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
GRAM_BLOCK = 6  # columns; 36 products, so that all sums are under the 100 fields of generated code
PEEK_ROWS = 1_000
BROADCAST_ROWS = 100_000  # largest rank table that is broadcast; its size is counted first
SALT_ROWS = 4_000_000  # rows of one value that a task of a rank join may hold


# -- outliers -------------------------------------------------------------------------


@dataclass(frozen=True)
class Bounds:
    """Values outside [low, high] are outliers; None: nothing is."""

    low: float | None
    high: float | None
    iqr: float | None = None


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, Bounds]:
    """Q1 - 1.5 IQR .. Q3 + 1.5 IQR with nearest-rank quartiles."""
    q = exact_quantiles(df, cols, [0.25, 0.75], "nearest")
    return {c: _bounds(*q[c]) for c in cols}


def _bounds(q1: float | None, q3: float | None) -> Bounds:
    if q1 is None:
        return Bounds(None, None)
    iqr = q3 - q1
    return Bounds(q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr, iqr)


@dataclass(frozen=True)
class Scale:
    mean: float | None
    std: float | None


def z_scales(df: DataFrame, cols: Sequence[str]) -> dict[str, Scale]:
    aggs = [f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev))]
    row = df.agg(*aggs).first()
    return {c: Scale(row[f"{c}__m"], row[f"{c}__s"]) for c in cols}


def iqr_flag(x: Column, b: Bounds) -> Column:
    if b.low is None:
        return F.when(x.isNotNull(), F.lit(False))
    return (x < F.lit(b.low)) | (x > F.lit(b.high))


def z_flag(x: Column, s: Scale, threshold: float = Z_LIMIT) -> Column:
    """|x - mean| / std > threshold; a constant column has no outliers."""
    if not s.std:
        return F.when(x.isNotNull(), F.lit(False))
    return F.abs((x - F.lit(s.mean)) / F.lit(s.std)) > F.lit(threshold)


def outlier_flags(
    df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr", threshold: float = Z_LIMIT
) -> dict[str, Column]:
    """Per numeric column, a boolean expression telling whether its value is an outlier."""
    if method not in OUTLIER_METHODS:
        raise ValueError(f"method must be one of {OUTLIER_METHODS}")
    cols = sel.pick(sel.numeric_columns(df), cols)
    x = lambda c: F.col(c).cast("double")
    if method == "iqr":
        bounds = iqr_bounds(df, cols)
        return {c: iqr_flag(x(c), bounds[c]) for c in cols}
    scales = z_scales(df, cols)
    return {c: z_flag(x(c), scales[c], threshold) for c in cols}


def flag_outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float = Z_LIMIT) -> DataFrame:
    """The table with ``is_outlier`` for one column."""
    return df.withColumn("is_outlier", outlier_flags(df, [col], method, threshold)[col])


def outlier_rows(
    df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr", only_outliers: bool = False
) -> DataFrame:
    """(column, value, is_outlier) for every non-null value: the scatter behind the chart."""
    flags = outlier_flags(df, cols, method)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), f.alias("is_outlier"))
            for c, f in flags.items()
        ]
    )
    rows = df.select(F.inline(entries)).where(F.col("value").isNotNull())
    return rows.where("is_outlier") if only_outliers else rows


# -- summaries ------------------------------------------------------------------------


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The profile's summary with IQR, skewness, kurtosis and outlier counts.

    The outlier values themselves are rows of :func:`outlier_rows`, not a list in a cell.
    """
    cols = sel.pick(sel.numeric_columns(df), cols)
    if not cols:
        return prof.numeric_summary(df, cols)
    counts = prof.numeric_counts(df, cols)
    facts = prof.column_facts(counts, {**prof.MEDIAN, "q1": (0.25, "nearest"), "q3": (0.75, "nearest")})
    base = prof.summary_rows(counts, facts, shape=True)
    bounds = {c: _bounds(f.quantiles["q1"], f.quantiles["q3"]) for c, f in facts.items()}
    scales = {c: Scale(f.mean, f.std) for c, f in facts.items()}
    # Flags differ by column, whose name decides which bounds a counted value meets.
    flags = {"iqr": F.lit(False), "zscore": F.lit(False)}
    for c in facts:
        mine = F.col("column") == c
        flags["iqr"] = F.when(mine, iqr_flag(F.col("value"), bounds[c])).otherwise(flags["iqr"])
        flags["zscore"] = F.when(mine, z_flag(F.col("value"), scales[c])).otherwise(flags["zscore"])
    found = counts.groupBy("column").agg(*[F.coalesce(F.sum(F.when(f, F.col("n"))), F.lit(0)).alias(f"outlier_count_{m}") for m, f in flags.items()])
    iqr = F.create_map(*[x for c in facts for x in (F.lit(c), F.lit(bounds[c].iqr).cast("double"))])
    found = found.select("column", round2(iqr[F.col("column")]).alias("iqr_value"), "outlier_count_iqr", "outlier_count_zscore")
    return base.join(F.broadcast(found), "column")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """String and boolean columns: counts, distinct values, entropy."""
    return prof.categorical_stats(df, cols)


def category_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of string and boolean columns, most frequent first."""
    cols = sel.pick(sel.string_columns(df) + sel.boolean_columns(df), cols)
    return value_counts(df, cols, "string").orderBy("column", F.desc("n"), "value")


def category_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, share): percent of rows per value, 1 dp.

    The total comes from the table itself, so nothing has to be windowed or joined.
    """
    cols = sel.pick(sel.string_columns(df) + sel.boolean_columns(df), cols)
    n = df.count()
    share = round_half_up(F.col("n") / F.lit(float(max(n, 1))) * F.lit(100.0), 1)
    return value_counts(df, cols, "string").select("column", "value", share.alias("share"))


# -- correlations -----------------------------------------------------------------------


def pearson_matrix(df: DataFrame, cols: Sequence[str] | None = None, nulls: str = "propagate") -> DataFrame:
    """(a, b, r) for every ordered pair of numeric columns, in one pass.

    A constant column gives null. ``propagate``: a column with a null gives null;
    ``pairwise``: each pair uses the rows where both are present.
    """
    cols = sel.pick(sel.numeric_columns(df), cols)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are required")
    if nulls not in ("propagate", "pairwise"):
        raise ValueError("nulls must be 'propagate' or 'pairwise'")
    if nulls == "propagate":
        return _gram_correlation(df, cols)
    x = [F.col(c).cast("double") for c in cols]
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), x[i].alias("x"), x[j].alias("y"))
            for i, a in enumerate(cols)
            for j, b in enumerate(cols)
            if i <= j
        ]
    )
    return _mirrored(_pair_correlation(df.select(F.inline(entries)), ["a", "b"], nulls))


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair (a, b, r), and one for a column with itself."""
    r = F.when((F.col("a") == F.col("b")) & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    out = pairs.select(F.explode(F.array_distinct(both)).alias("p"), r.alias("r"))
    return out.select("p.a", "p.b", "r")


def _gram_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) from the Gram matrix of the columns, in blocks of ``GRAM_BLOCK`` by ``GRAM_BLOCK``.

    A row gives one entry for each pair of blocks, whose products are summed map-side by
    generated code, so one row for each pair of blocks and task is shuffled. Values are taken
    about the mean of some first rows, so that large means cost no digits.
    """
    named = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    finite = [F.avg(F.when(F.abs(F.col(c)) < float("inf"), F.col(c))) for c in named.columns]
    shifted = [F.col(c) - F.lit(m or 0.0) for c, m in zip(named.columns, named.limit(PEEK_ROWS).agg(*finite).first())]
    starts = range(0, len(cols), GRAM_BLOCK)
    block = lambda s: F.array(*shifted[s : s + GRAM_BLOCK])
    pairs = [(i, j) for i in starts for j in starts if i <= j]
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), block(i).alias("x"), block(j).alias("y")) for i, j in pairs]
    rows = named.select(F.inline(F.array(*entries)))
    at = [(p, q) for p in range(GRAM_BLOCK) for q in range(GRAM_BLOCK)]
    left = {p: F.get("x", F.lit(p)) for p in range(GRAM_BLOCK)}
    right = {q: F.get("y", F.lit(q)) for q in range(GRAM_BLOCK)}
    rows = rows.select("i", "j", *[c.alias(f"x{p}") for p, c in left.items()], *[c.alias(f"y{q}") for q, c in right.items()])
    product = lambda p, q: F.sum(F.when((F.col("i") < F.col("j")) | (p <= q), F.col(f"x{p}") * F.col(f"y{q}"))).alias(f"s{p}_{q}")
    alone = F.col("i") == F.col("j")
    sums = rows.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), *[product(p, q) for p, q in at],
        *[F.sum(F.when(alone, F.col(f"x{p}"))).alias(f"t{p}") for p in range(GRAM_BLOCK)], *[F.count(F.when(alone, F.col(f"x{p}"))).alias(f"c{p}") for p in range(GRAM_BLOCK)],
    )
    cross, total, n = {}, {}, {}
    for r in sums.collect():
        cross.update({(r["i"] + p, r["j"] + q): r[f"s{p}_{q}"] for p, q in at})
        if r["i"] == r["j"]:
            total.update({r["i"] + p: (r[f"t{p}"], r[f"c{p}"]) for p in range(GRAM_BLOCK)})
            n = r["n"]
    rows_out = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            rows_out.append((a, cols[j], _correlation(n, total.get(i), total.get(j), cross.get((i, j)), cross.get((i, i)), cross.get((j, j)))))
    return _mirrored(df.sparkSession.createDataFrame(rows_out, "a string, b string, r double"))


def _correlation(n, one, two, both, own, other) -> float | None:
    """Pearson's r from sums, products and squares; None with a null or a constant side."""
    if not n or one[1] < n or two[1] < n:
        return None
    covariance, mine, its = (p - s[0] * t[0] / n for p, s, t in ((both, one, two), (own, one, one), (other, two, two)))
    # A constant column has nothing but rounding left.
    if any(v <= 1e-14 * max(abs(p), 1e-300) for v, p in ((mine, own), (its, other))):
        return None
    return covariance / math.sqrt(mine * its)


def _pair_correlation(pairs: DataFrame, by: Sequence[str], nulls: str) -> DataFrame:
    """(by..., r) from entries (by..., x, y), summed map-side: one row per pair is shuffled.

    Moments are combined by hand because ``corr`` raises on a constant side.
    """
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    sums = pairs.groupBy(*by).agg(
        F.covar_pop(x, y).alias("c"),
        F.stddev_pop(x).alias("sx"),
        F.stddev_pop(y).alias("sy"),
        F.count_if(~both).alias("gaps"),
    )
    r = F.try_divide("c", F.col("sx") * F.col("sy"))
    if nulls == "propagate":
        r = F.when(F.col("gaps") == 0, r)
    return sums.select(*by, r.alias("r"))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n, rank): mean position of each distinct value, ties shared."""
    rank = F.col("cum") - F.col("n") + (F.col("n") + F.lit(1.0)) / F.lit(2.0)
    return ranked_counts(df, cols).select("column", "value", "n", rank.alias("rank"))


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix of the average ranks; a column with nulls gives null.

    Ranks are computed per distinct value and joined back: broadcast where the counted
    rank table is small, else a shuffle join in which frequent values are salted.
    """
    cols = sel.pick(sel.numeric_columns(df), cols)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are required")
    ranks = materialize(average_ranks(df, cols))
    sizes = {
        r["column"]: (r["rows"], r["total"])
        for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).collect()
    }
    out = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    out = out.withColumn("__id", F.monotonically_increasing_id())
    for i, c in enumerate(cols):
        size, total = sizes.get(c, (0, 0))
        mine = ranks.where(F.col("column") == c)
        out = _attach_rank(out, mine, c, f"__r{i}", size, total)
    named = out.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(cols)])
    return pearson_matrix(named, cols)


def _attach_rank(rows: DataFrame, ranks: DataFrame, col: str, name: str, size: int, total: int) -> DataFrame:
    keep = [c for c in rows.columns]
    if size <= BROADCAST_ROWS:
        small = ranks.select(F.col("value").alias("__v"), F.col("rank").alias(name))
        joined = rows.join(F.broadcast(small), F.col(col) == F.col("__v"), "left")
        return joined.select(*keep, name)
    # A value gets as many salts as its rows need tasks; there are at most total / SALT_ROWS
    # values with more than one, which is the size of what is broadcast.
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("bigint")
    hot = ranks.where(F.col("n") > SALT_ROWS).select(F.col("value").alias("__hot"), salts.alias("__salts"))
    right = ranks.select(
        F.col("value").alias("__v"), F.col("rank").alias(name),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(salts - 1, F.lit(0)))).alias("__s2"),
    )
    left = rows
    if total > SALT_ROWS:
        left = rows.join(F.broadcast(hot), F.col(col) == F.col("__hot"), "left").drop("__hot")
        left = left.withColumn("__s1", F.pmod("__id", F.coalesce("__salts", F.lit(1)))).drop("__salts")
    else:
        left = rows.withColumn("__s1", F.lit(0).cast("bigint"))
    on = (F.col(col) == F.col("__v")) & (F.col("__s1") == F.col("__s2"))
    return left.join(right, on, "left").select(*keep, name)


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """(feature, r) with the target, highest first; exact 1.0 is left out."""
    cols = sel.numeric_columns(df)
    if target not in cols:
        raise ValueError(f"target {target!r} must be a numeric column")
    others = [c for c in cols if c != target]
    y = F.col(target).cast("double").alias("y")
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), y) for c in others]
    )
    rows = _pair_correlation(df.select(F.inline(entries)), ["feature"], "propagate")
    return rows.where(F.col("r").isNull() | (F.col("r") != 1.0)).orderBy(F.desc_nulls_last("r"), "feature")


# -- groups -----------------------------------------------------------------------------

GROUP_STATS = ("count", "mean", "median", "std", "min", "max")


def group_analysis(df: DataFrame, by: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Per group of a string column: count, mean, median, std, min, max of numeric columns.

    Moments are map-side combined. Exact medians come from value counts keyed by group,
    column and value, so a group with a third of all rows is still spread.
    """
    if by not in sel.string_columns(df):
        raise ValueError(f"{by!r} must be a string column")
    cols = sel.pick([c for c in sel.numeric_columns(df) if c != by], cols)
    if not cols:
        raise ValueError("no valid numeric columns found")
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_count"),
            round_half_up(F.avg(c), 2).alias(f"{c}_mean"),
            round_half_up(F.stddev(c), 2).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    base = df.groupBy(by).agg(*aggs)
    med = grouped_quantiles(df.select(by, *cols), cols, {"median": 0.5}, [by])
    wide = med.groupBy(F.col(by).alias("__g")).agg(
        *[round_half_up(F.max(F.when(F.col("column") == c, F.col("median"))), 2).alias(f"{c}_median") for c in cols]
    )
    out = base.join(wide, F.col(by).eqNullSafe(F.col("__g")), "left")
    return out.select(by, *[f"{c}_{s}" for c in cols for s in GROUP_STATS])


def group_means(df: DataFrame, by: str, sort_by: str | None = None) -> DataFrame:
    """Mean of every numeric column per group; sorted descending by one of them."""
    if by not in sel.string_columns(df):
        raise ValueError(f"{by!r} is not a string column")
    cols = sel.numeric_columns(df)
    if sort_by is not None and sort_by not in cols:
        raise ValueError(f"{sort_by!r} is not a numeric column")
    out = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])
    return out.orderBy(F.desc(sort_by), by) if sort_by else out


def group_points(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    size: str | None = None,
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """The points of a scatter; ``fraction`` draws a seeded sample."""
    out = df.select(*dict.fromkeys(c for c in (x, y, color, size) if c))
    return out if fraction is None else out.sample(fraction, seed)


# -- chart rows -------------------------------------------------------------------------


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """(column, bin, low, high, n): equal-width bins between the least and largest finite value.

    Empty bins are there with n = 0. NaN and infinite values are counted in a row without bin
    and bounds, which a column without any does not have.
    """
    cols = sel.pick(sel.numeric_columns(df), cols)
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in cols}
    row = df.agg(*[f(x).alias(f"{c}__{n}") for c, x in finite.items() for n, f in (("a", F.min), ("b", F.max))]).first()
    entries, edges = [], []
    for c, x in finite.items():
        lo, hi = row[f"{c}__a"], row[f"{c}__b"]
        width = 0.0 if lo is None else (hi - lo) / bins
        b = F.lit(0) if width == 0 else F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        entries.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), b).alias("bin"))))
        if lo is not None:
            edges += [(c, i, lo + i * width, lo + (i + 1) * width) for i in range(bins if width else 1)]
    counts = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.column", "e.bin").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as columns times bins.
    bounds = df.sparkSession.createDataFrame(edges, "column string, bin int, low double, high double")
    found = counts.join(F.broadcast(bounds), ["column", "bin"], "full" if edges else "left")
    return found.select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def box_rows(df: DataFrame, cols: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """(by, column, min, q1, median, q3, max): five-number summary, quartiles interpolated."""
    cols = sel.pick(sel.numeric_columns(df), cols)
    keys = [by] if by else []
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    if by:
        return grouped_quantiles(df.select(by, *cols), cols, probs, keys)
    q = exact_quantiles(df, cols, list(probs.values()))
    rows = [(c, *[None if v is None else float(v) for v in q[c]]) for c in cols]
    schema = "column string, " + ", ".join(f"{n} double" for n in probs)
    return df.sparkSession.createDataFrame(rows, schema)


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y over x: slope, intercept, r2."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.groupBy(*by) if by else df
    both = a.isNotNull() & b.isNotNull()
    x2, y2 = F.when(both, a), F.when(both, b)
    agg = out.agg(
        F.covar_pop(x2, y2).alias("__c"),
        F.var_pop(x2).alias("__vx"),
        F.var_pop(y2).alias("__vy"),
        F.avg(x2).alias("__mx"),
        F.avg(y2).alias("__my"),
        F.count_if(both).alias("n"),
    )
    slope = F.try_divide("__c", "__vx")
    return agg.select(
        *by,
        "n",
        slope.alias("slope"),
        (F.col("__my") - slope * F.col("__mx")).alias("intercept"),
        F.try_divide(F.col("__c") * F.col("__c"), F.col("__vx") * F.col("__vy")).alias("r2"),
    )


def metric_rows(df: DataFrame, model_col: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """(model, metric, value): one series per numeric metric column."""
    names = list(metrics) if metrics else [c for c in sel.numeric_columns(df) if c != model_col]
    return df.select(
        model_col, *[F.col(c).cast("double").alias(c) for c in names]
    ).unpivot([model_col], names, "metric", "value")


def residual_rows(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Adds residual = y - yhat."""
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def mean_residuals(df: DataFrame, model_col: str = "model", y: str = "y", yhat: str = "yhat") -> DataFrame:
    return residual_rows(df, y, yhat).groupBy(model_col).agg(F.avg("residual").alias("mean_residual"))


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows of an explicit order (no full sort is planned)."""
    return df.orderBy(*order).limit(k)


# -- report -----------------------------------------------------------------------------


def dataset_info(df: DataFrame) -> DataFrame:
    """Row and column counts by type class, total nulls, size in MB."""
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    fixed = df.agg(F.count(F.lit(1)).alias("total_rows"), total.alias("missing_values_total"))
    return fixed.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(sel.numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(sel.string_columns(df))).cast("bigint").alias("categorical_columns"),
        F.lit(len(sel.boolean_columns(df))).cast("bigint").alias("boolean_columns"),
        "missing_values_total",
    )


def full_report(df: DataFrame) -> dict[str, DataFrame]:
    """The parts of an exploratory report, each a small table."""
    parts = {
        "dataset_info": dataset_info(df),
        "memory_usage": prof.table_size(df),
        "numeric_summary": numeric_summary(df),
        "categorical_summary": categorical_summary(df),
    }
    if len(sel.numeric_columns(df)) >= 2:
        parts["correlation_matrix"] = pearson_matrix(df)
    return parts


def report_rows(df: DataFrame) -> DataFrame:
    """The whole report in long form: (part, row, metric, value), every value of every part.

    A mode is a row of metric mode_1 to mode_5, a pair of the correlation matrix has the columns
    as row and metric, and category_counts has one metric for each value (null: no name).
    """
    parts = full_report(df)

    def long(part: str, rows: DataFrame, row: Column, metrics: Sequence[str]) -> DataFrame:
        entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return rows.select(F.lit(part).alias("part"), row.alias("row"), F.inline(F.array(*entries)))

    def values(part: str, rows: DataFrame, row: str, metric: str | Column, value: str) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.col(row).alias("row"), metric if isinstance(metric, Column) else F.col(metric), F.col(value).cast("double").alias("value"))

    whole = F.lit("*")
    out = [long(n, parts[n], whole, parts[n].columns) for n in ("dataset_info", "memory_usage")]
    numeric = parts["numeric_summary"]
    if numeric.columns[1:]:
        out.append(long("numeric_summary", numeric, F.col("column"), [c for c in numeric.columns if c not in ("column", "mode")]))
        modes = numeric.select("column", F.posexplode("mode").alias("i", "value"))
        out.append(values("numeric_summary", modes, "column", F.concat(F.lit("mode_"), F.col("i") + 1).alias("metric"), "value"))
    categorical = parts["categorical_summary"]
    out.append(long("categorical_summary", categorical, F.col("column"), categorical.columns[1:]))
    if sel.string_columns(df) + sel.boolean_columns(df):
        out.append(values("category_counts", category_counts(df), "column", F.col("value").alias("metric"), "n"))
    if "correlation_matrix" in parts:
        out.append(values("correlation_matrix", parts["correlation_matrix"], "a", F.col("b").alias("metric"), "r"))
    return sel.stack(out).select("part", "row", "metric", "value")
