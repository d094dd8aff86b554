"""Exact order statistics that do not need a sort of the table or one big buffer.

Spark's exact ``percentile`` keeps every distinct value of a group in one task. It is used
only for small tables; above, the value at a rank is found in a few scans: a sketch, merged in
stages, brackets the rank, then only the values inside the bracket are counted.

Quantiles by group, ranks and column summaries come from counts of distinct values that are cut
into ranges of about ``PART_ROWS`` of them. A histogram by key and range says in which range a
rank lies; only that range's values are put in order. So no key, however large, is one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators.ordered import OrderedFrame, SeriesSpec
from demandspark.session import materialize

MAX_ROWS = 8_000_000  # values (over all columns) that one task may hold
#: Size of a sketch (at most about three times as many values) and by how much, as a share of the
#: rows, a bracket is wider than what the sketch says; the error of such a sketch is under 0.1 %.
SKETCH_SIZE = 4_000
SKETCH_MARGIN = 0.003
#: Distinct values of one range.
PART_ROWS = 1_000_000


def nearest_rank(q: float, n: int) -> int:
    """0-based rank of the nearest-rule quantile."""
    return math.floor(q * (n - 1) + 0.5)


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "linear", max_rows: int = MAX_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, as driver scalars (len(cols) * len(probs) of them).

    ``linear`` interpolates between neighbours, ``nearest`` picks a row's value; nulls
    are left out; a column without values gives None.
    """
    return mixed_quantiles(df, cols, [(q, method) for q in probs], max_rows)


def mixed_quantiles(
    df: DataFrame, cols: Sequence[str], wanted: Sequence[tuple[float, str]], max_rows: int = MAX_ROWS
) -> dict[str, list[float | None]]:
    """Like :func:`exact_quantiles`, with a (probability, method) pair per quantile."""
    for _, method in wanted:
        if method not in ("linear", "nearest"):
            raise ValueError(f"unknown method {method!r}")
    cols = list(dict.fromkeys(cols))
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()

    def ranks(n: int, q: float, method: str) -> tuple[int, int]:
        if method == "nearest":
            return (nearest_rank(q, n),) * 2
        return math.floor(q * (n - 1)), math.ceil(q * (n - 1))

    needed = {c: {r for q, m in wanted if counts[c] for r in ranks(counts[c], q, m)} for c in cols}
    values = values_at_ranks(df, needed, {c: counts[c] for c in cols}, max_rows)

    def pick(c: str, q: float, method: str) -> float | None:
        n = counts[c]
        if not n:
            return None
        lo, hi = (values[c][r] for r in ranks(n, q, method))
        pos = q * (n - 1)
        return lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))

    return {c: [pick(c, q, m) for q, m in wanted] for c in cols}


def values_at_ranks(
    df: DataFrame, wanted: dict[str, set[int]], counts: dict[str, int], max_rows: int = MAX_ROWS
) -> dict[str, dict[int, float]]:
    """Values (as double) at 0-based ascending ranks of each column's non-null values."""
    cells = sum(counts[c] for c in wanted if wanted[c])
    if cells <= max_rows:
        quick = _small_values(df, wanted, counts)
        if quick is not None:
            return quick
    out: dict[str, dict[int, float]] = {c: {} for c in wanted}
    # Brackets: (column, rank, low, high, rows up to low, rows inside); bounds exclusive,
    # None = unbounded; 0 rows inside = low is the answer, -1 = count whatever is inside.
    todo = [(c, r, None, None, 0, counts[c]) for c, ranks in wanted.items() for r in sorted(ranks)]
    while todo:
        narrow = [t for t in todo if t[5] > max_rows]
        ready = [t for t in todo if t[5] <= max_rows]
        for c, r, value in _count_in_brackets(df, ready):
            out[c][r] = value
        todo = _tighten(df, narrow) if narrow else []
    return out


def _fraction(rank: int, n: int) -> float | None:
    """A p with p * (n - 1) == rank in double arithmetic, so nothing is interpolated."""
    p = rank / (n - 1) if n > 1 else 0.0
    for q in (p, math.nextafter(p, 2.0), math.nextafter(p, -1.0)):
        if 0.0 <= q <= 1.0 and q * (n - 1) == rank:
            return q
    return None


def _small_values(df: DataFrame, wanted: dict, counts: dict) -> dict[str, dict[int, float]] | None:
    """One aggregate for tables whose distinct values fit a task; None if a rank has no
    exact fraction."""
    plan = {c: [(r, _fraction(r, counts[c])) for r in sorted(ranks)] for c, ranks in wanted.items() if ranks}
    if any(p is None for pairs in plan.values() for _, p in pairs):
        return None
    if not plan:
        return {c: {} for c in wanted}
    aggs = [
        F.percentile(F.col(c).cast("double"), [p for _, p in pairs]).alias(f"q{i}")
        for i, (c, pairs) in enumerate(plan.items())
    ]
    row = df.agg(*aggs).first()
    found = {c: dict(zip([r for r, _ in pairs], row[f"q{i}"])) for i, (c, pairs) in enumerate(plan.items())}
    return {c: found.get(c, {}) for c in wanted}


def _inside(c: str, lo, hi):
    x = F.col(c).cast("double")
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x > F.lit(lo))
    if hi is not None:
        cond = cond & (x < F.lit(hi))
    return cond


def _tighten(df: DataFrame, todo: list) -> list:
    """Shrink brackets with a sketch of the rows inside, then count around the result."""
    brackets = _brackets(todo)
    sketches = staged_sketches(df, [F.when(_inside(c, lo, hi), F.col(c).cast("double")) for c, _, lo, hi, _b, _n in brackets])
    slots = {(t[0], t[2], t[3]): i for i, t in enumerate(brackets)}
    ends = []
    for i, (c, r, lo, hi, below, n) in enumerate(todo):
        p, sketch = (r - below) / max(n - 1, 1), F.col(f"k{slots[(c, lo, hi)]}")
        at = [F.kll_sketch_get_quantile_double(sketch, F.lit(x)) for x in (max(0.0, p - SKETCH_MARGIN), min(1.0, p + SKETCH_MARGIN))]
        ends.append(F.array(*at).alias(f"b{i}"))
    row = sketches.select(*ends).first()
    checks = []
    for i, (c, _, lo, hi, _b, _n) in enumerate(todo):
        x = F.col(c).cast("double")
        a, b = row[f"b{i}"]
        checks += [F.count_if(x < a).alias(f"l{i}"), F.count_if(x <= b).alias(f"u{i}")]
        checks += [F.count_if(x == a).alias(f"ea{i}"), F.count_if(x == b).alias(f"eb{i}")]
    got = df.agg(*checks).first()
    result = []
    for i, (c, r, lo, hi, below, n) in enumerate(todo):
        a, b = row[f"b{i}"]
        first = got[f"l{i}"] + got[f"ea{i}"]  # rank of the first value above a
        last = got[f"u{i}"] - got[f"eb{i}"]  # rank of the first value at b
        if got[f"l{i}"] <= r < first:
            result.append((c, r, a, a, r, 0))
        elif last <= r < got[f"u{i}"]:
            result.append((c, r, b, b, r, 0))
        elif first <= r < last and last - first < n:
            result.append((c, r, a, b, first, last - first))
        else:
            # The sketch missed or could not narrow: keep the bracket, count it in tasks.
            result.append((c, r, lo, hi, below, -1))
    return result


def staged_sketches(df: DataFrame, values: Sequence[Column], counts: Sequence[Column] = ()) -> DataFrame:
    """One row of sketches k0, k1, .. of the values and sums c0, c1, .. of the counts, merged in two
    stages.

    Tasks' sketches first meet in as many groups as the square root of their number, so that
    neither stage brings more than that many together.
    """
    tasks = df.rdd.getNumPartitions()
    group = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks)))).alias("__g")
    named = df.withColumns({"__g": group, **{f"__v{i}": v for i, v in enumerate(values)}})
    some = named.groupBy("__g").agg(
        *[F.kll_sketch_agg_double(f"__v{i}", F.lit(SKETCH_SIZE)).alias(f"k{i}") for i in range(len(values))], *[c.alias(f"c{i}") for i, c in enumerate(counts)]
    )
    return some.agg(
        *[F.kll_merge_agg_double(f"k{i}", F.lit(SKETCH_SIZE)).alias(f"k{i}") for i in range(len(values))],
        *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(counts))],
    )


def _count_in_brackets(df: DataFrame, todo: list) -> list:
    """(column, rank, value) from the value counts inside each bracket."""
    done = [(c, r, lo) for c, r, lo, hi, _, n in todo if n == 0]
    todo = [t for t in todo if t[5] != 0]
    if not todo:
        return done
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    _inside(c, lo, hi),
                    F.struct(F.lit(i).alias("b"), F.col(c).cast("double").alias("v")),
                )
                for i, (c, _, lo, hi, _b, _n) in enumerate(_brackets(todo))
            ]
        )
    )
    counts = (
        df.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.b").alias("b"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wide = any(t[5] < 0 for t in todo)
    spec = SeriesSpec(("v",), ("b",), mode="auto" if wide else "plain")
    cum = OrderedFrame(materialize(counts) if wide else counts, spec).running_sum("n", "cum").df
    slots = {(c, lo, hi): i for i, (c, _, lo, hi, _b, _n) in enumerate(_brackets(todo))}
    hits = []
    for c, r, lo, hi, below, _ in todo:
        k = r - below
        at = (F.col("b") == slots[(c, lo, hi)]) & (F.col("cum") > k) & (F.col("cum") - F.col("n") <= k)
        hits.append(F.when(at, F.lit(len(hits))))
    found = (
        cum.select("v", F.explode(F.array_compact(F.array(*hits))).alias("hit")).collect()
    )
    return done + [(todo[f["hit"]][0], todo[f["hit"]][1], f["v"]) for f in found]


def _brackets(todo: list) -> list:
    """One entry per distinct (column, low, high)."""
    seen: dict = {}
    for t in todo:
        seen.setdefault((t[0], t[2], t[3]), t)
    return list(seen.values())


# -- value counts -------------------------------------------------------------------


def melt(df: DataFrame, cols: Sequence[str], dtype: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value): one row per input row and column, in one pass."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast(dtype).alias("value")) for c in cols]
    )
    return df.select(*by, F.inline(entries))


def value_counts(df: DataFrame, cols: Sequence[str], dtype: str = "double", by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value, n), null counted as one value.

    Equal values are combined before the shuffle, and the shuffle key contains the value,
    so neither a hot value nor a hot group lands on one task.
    """
    if dtype != "double":
        return melt(df, cols, dtype, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Whole numbers are counted as such: as doubles, distinct values above 2^53 would merge.
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    none_i, none_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (F.col(c).cast("bigint") if c in whole else none_i).alias("i"),
                (none_d if c in whole else F.col(c).cast("double")).alias("d"),
            )
            for c in cols
        ]
    )
    counts = df.select(*by, F.inline(entries)).groupBy(*by, "column", "i", "d").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, "column", F.coalesce("d", F.col("i").cast("double")).alias("value"), "n")


def ranged(counts: DataFrame, by: Sequence[str] = (), max_rows: int = PART_ROWS) -> DataFrame:
    """Counts (by..., column, value, n) of non-null values with ``part``, their range of values.

    Ranges are of about ``max_rows`` rows over all columns and groups, and are written, so that a
    row's range stays what it is.
    """
    counts = counts.where(F.col("value").isNotNull())
    parts = -(-counts.count() // max_rows)
    if parts <= 1:
        return counts.withColumn("part", F.lit(0))
    return materialize(counts.repartitionByRange(parts, "column", "value", *by).withColumn("part", F.spark_partition_id()))


def _keyed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with their group and column as one key that equals itself with nulls inside."""
    return rows.withColumn("__key", F.struct(*by, "column"))


def _histogram(rows: DataFrame) -> DataFrame:
    """(__key, part, m, before, total): rows of each range, before it, and of the key.

    One row for each key and range: as few are windowed by key.
    """
    w = Window.partitionBy("__key")
    hist = rows.groupBy("__key", "part").agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select("__key", "part", "m", (upto - F.col("m")).alias("before"), F.sum("m").over(w).alias("total"))


def _cum_in_part() -> Column:
    """Rows of the key's range up to and including the value."""
    return F.sum("n").over(Window.partitionBy("__key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))


def ranked_counts(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), max_rows: int = PART_ROWS
) -> DataFrame:
    """Value counts of non-null values with ``cum``, the number of rows up to each value."""
    rows = _keyed(ranged(materialize(value_counts(df, cols, "double", by)), by, max_rows), by)
    hist = _histogram(rows).select("__key", "part", "before")
    placed = rows.withColumn("cum", _cum_in_part()).join(hist, ["__key", "part"])
    return placed.select(*by, "column", "value", "n", (F.col("cum") + F.col("before")).alias("cum"))


def grouped_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: dict[str, float],
    by: Sequence[str] = (),
    method: str = "linear",
    max_rows: int = PART_ROWS,
) -> DataFrame:
    """(by..., column, <name per quantile>) for every group, exact at any group size."""
    counts = materialize(value_counts(df, cols, "double", by))
    return count_quantiles(counts, {name: (q, method) for name, q in probs.items()}, by, max_rows)


def count_quantiles(
    counts: DataFrame, wanted: dict[str, tuple[float, str]], by: Sequence[str] = (), max_rows: int = PART_ROWS
) -> DataFrame:
    """(by..., column, <name per quantile>) from counts (by..., column, value, n) that are cheap to
    read; ``wanted`` has a probability and a method by name."""
    rows = _keyed(ranged(counts, by, max_rows), by)
    entries = []
    for name, (q, method) in wanted.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        ends = {"": F.floor(pos + F.lit(0.5))} if method == "nearest" else {"lo": F.floor(pos), "hi": F.ceil(pos)}
        entries += [F.struct(F.lit(f"{name}{e}").alias("name"), rank.cast("bigint").alias("rank")) for e, rank in ends.items()]
    hist = _histogram(rows)
    asked = hist.select("*", F.inline(F.array(*entries)))
    asked = asked.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
    # A row for each key, quantile and end; the values of their ranges alone are put in order.
    asked = materialize(asked.select("__key", "part", "name", (F.col("rank") - F.col("before")).alias("at"), "total"))
    inside = rows.join(asked.select("__key", "part").distinct(), ["__key", "part"], "left_semi")
    inside = inside.select("__key", "part", "value", _cum_in_part().alias("cum"), "n")
    found = inside.join(asked, ["__key", "part"]).where((F.col("cum") > F.col("at")) & (F.col("cum") - F.col("n") <= F.col("at")))
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    aggs = [value(f"{name}{e}").alias(f"__{e}_{name}") for name, (_, m) in wanted.items() for e in ([""] if m == "nearest" else ["lo", "hi"])]
    out = found.groupBy("__key").agg(F.max("total").alias("total"), *aggs)
    cols = []
    for name, (q, method) in wanted.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cols.append((F.col(f"___{name}") if method == "nearest" else lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*[F.col("__key")[k].alias(k) for k in (*by, "column")], *cols)


def top_values(counts: DataFrame, limit: int, by: Sequence[str] = ("column",)) -> DataFrame:
    """The ``limit`` most frequent values per column; ties by value ascending."""
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
