"""Ordered-series operators: lag, lead, difference, rolling, fills, index, running sum.

A series is a table with an explicit total order (``order_by``) and optional keys
(``partition_by``). Two layouts give equal results:

* plain   - ``Window.partitionBy(keys).orderBy(order)``. Right when every key fits a task.
* chunked - the (keys, order) space is cut by sampled row values into ranges of about
  ``max_rows`` rows, so one hot key, or one single unkeyed series, spreads over many
  tasks. A range boundary is a row *value*: a row's chunk does not depend on where or
  how often it is computed. Operators of bounded reach get copies of the neighbouring
  rows (halo); fills, index and running sum get one carried row per chunk.

``auto`` counts the rows, samples boundaries only for tables above ``max_rows``, and
stays plain unless some key spans a whole chunk.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.session import materialize

#: Values by chunk are literals of the plan up to so many chunks, a broadcast table beyond.
LITERALS = 5_000
SAMPLES_PER_CHUNK = 20
_CHUNK = "__chunk"
_HALO = "__halo"


@dataclass(frozen=True)
class SeriesSpec:
    """Order, keys and layout of a series.

    ``mode="plain"`` is the caller's statement that no key exceeds a task (for example
    one row per key and hour); ``chunked`` forces ranges, ``auto`` decides by size.
    """

    order_by: tuple[str, ...]
    partition_by: tuple[str, ...] = ()
    max_rows: int = 4_000_000
    mode: str = "auto"

    def __post_init__(self) -> None:
        if not self.order_by:
            raise ValueError("order_by needs at least one column")
        if self.mode not in ("auto", "plain", "chunked"):
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def columns(self) -> list[str]:
        return [*self.partition_by, *self.order_by]


@dataclass(frozen=True)
class Op:
    """One new column. ``back``/``ahead`` say how many rows it looks behind/ahead."""

    name: str
    back: int
    ahead: int
    build: object = field(compare=False)  # (WindowSpec) -> Column


def lag(col: str, k: int, name: str | None = None) -> Op:
    """Value ``k`` rows earlier; 0 is the current row."""
    if k < 0:
        raise ValueError("lag must be >= 0")
    return Op(name or f"{col}_lag_{k}hr", k, 0, lambda w: F.lag(col, k).over(w))


def lead(col: str, k: int = 1, name: str | None = None) -> Op:
    return Op(name or f"{col}_lead_{k}hr", 0, k, lambda w: F.lead(col, k).over(w))


def difference(col: str, k: int, name: str | None = None) -> Op:
    """Value minus the value ``k`` rows earlier."""
    return Op(
        name or f"{col}_diff_{k}hr", k, 0, lambda w: F.col(col) - F.lag(col, k).over(w)
    )


def rolling_mean(col: str, rows: int, name: str | None = None) -> Op:
    """Mean of the last ``rows`` rows; null until all of them have a value."""

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(col).over(frame) == rows, F.avg(col).over(frame))

    return Op(name or f"{col}_rolling_mean_{rows}hr", rows - 1, 0, build)


def rolling_median(col: str, rows: int, name: str | None = None) -> Op:
    """Median of the last ``rows`` rows; null until all of them have a value."""

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(rows - 1), 0)
        ranked = F.sort_array(F.collect_list(F.col(col).cast("double")).over(frame))
        mid = rows // 2
        value = F.get(ranked, F.lit(mid))
        if rows % 2 == 0:
            value = (F.get(ranked, F.lit(mid - 1)) + value) / F.lit(2.0)
        return F.when(F.size(ranked) == rows, value)

    return Op(name or f"{col}_rolling_median_{rows}hr", rows - 1, 0, build)


class OrderedFrame:
    """A DataFrame with a resolved series layout; methods return new frames."""

    def __init__(self, df: DataFrame, spec: SeriesSpec):
        missing = [c for c in spec.columns if c not in df.columns]
        if missing:
            raise ValueError(f"unknown series columns: {missing}")
        self.spec = spec
        self._ranges = _choose_ranges(df, spec)
        self._df = _tag(df, spec, self._ranges) if self.chunked else df
        # Chunked only: a frame whose columns outside ``_derived`` equal those of ``_df``.
        # Carried rows of such columns are read from it, without the windows on top.
        self._base = self._df
        self._derived: set[str] = set()

    # -- layout ---------------------------------------------------------------------

    @property
    def chunked(self) -> bool:
        return self._ranges is not None

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_CHUNK) if self.chunked else self._df

    def _next(self, df: DataFrame, derived: Iterable[str]) -> OrderedFrame:
        out = copy.copy(self)
        out._df = df
        out._derived = self._derived | set(derived)
        return out

    def _settled(self, cols: Iterable[str]) -> OrderedFrame:
        """A frame in which ``cols`` can be read without recomputing windows.

        Columns made by earlier stages are written once to the checkpoint folder; both the
        carried rows and the next stage then read the files.
        """
        if not self.chunked or not self._derived.intersection(cols):
            return self
        out = copy.copy(self)
        out._df = out._base = materialize(self._df)
        out._derived = set()
        return out

    def _window(self, descending: bool = False) -> WindowSpec:
        keys = [_CHUNK, *self.spec.partition_by] if self.chunked else self.spec.partition_by
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.spec.order_by]
        return Window.partitionBy(*keys).orderBy(*order)

    def transform(self, fn) -> OrderedFrame:
        """Apply a row-local DataFrame function; rows, keys and order must stay."""
        out = fn(self._df)
        return self._next(out, [c for c in out.columns if c not in (*self.spec.columns, _CHUNK)])

    # -- bounded reach ----------------------------------------------------------------

    def with_ops(self, ops: Sequence[Op]) -> OrderedFrame:
        """Add lag / lead / difference / rolling columns, all in one window stage."""
        if not ops:
            return self
        df, halo = self._df, False
        if self.chunked:
            back, ahead = max(o.back for o in ops), max(o.ahead for o in ops)
            if back or ahead:
                df, halo = self._with_halo(back, ahead), True
        w = self._window()
        out = df.select("*", *[o.build(w).alias(o.name) for o in ops])
        if halo:
            out = out.where(~F.col(_HALO)).drop(_HALO)
        return self._next(out, [o.name for o in ops])

    def _with_halo(self, back: int, ahead: int) -> DataFrame:
        """Copy the last ``back`` / first ``ahead`` rows of each chunk to its neighbours.

        A narrow pass over keys and order finds, per chunk, the row value from which the
        copies start. The main pass is then a projection before its one shuffle.
        """
        spec, ranges = self.spec, self._ranges
        keys = list(spec.partition_by)
        narrow = self._base.select(_CHUNK, *spec.columns)
        n_chunks = len(ranges) + 1
        start_keys = [None] + [r[: len(keys)] for r in ranges]
        tails = _edge_rows(narrow, spec, ranges, back, last=True) if back else {}
        heads = _edge_rows(narrow, spec, ranges, ahead, last=False) if ahead else {}

        # A chunk in which the crossing key ends has no tail of that key and stops the copies;
        # one that the key fills entirely counts with its rows, up to the reach.
        def forward(c: int) -> int:
            """How many next chunks need the end of chunk ``c``."""
            steps = seen = 0
            for t in range(c + 1, n_chunks):
                steps, seen = steps + 1, seen + (tails[t][1] if t in tails else back)
                if seen >= back or t + 1 >= n_chunks or start_keys[t + 1] != start_keys[c + 1]:
                    break
            return steps

        def backward(c: int) -> int:
            """How many earlier chunks need the start of chunk ``c``."""
            steps = seen = 0
            for t in range(c - 1, -1, -1):
                steps, seen = steps + 1, seen + (heads[t][1] if t in heads else ahead)
                if seen >= ahead or t == 0 or start_keys[t] != start_keys[c]:
                    break
            return steps

        position = _Position(self._df, spec)
        here, zero = F.col(_CHUNK), F.lit(0)
        data = [c for c in self._df.columns if c != _CHUNK]
        edges, counts = {}, {}
        in_tail = in_head = F.lit(False)
        ahead_by = back_by = zero
        if tails:
            edges["__tail"] = [tails[c][0] if c in tails else None for c in range(n_chunks)]
            counts["__ahead"] = [forward(c) if c in tails else 0 for c in range(n_chunks)]
            in_tail = position.crosses(F.col("__tail")) & (position.row >= F.col("__tail"))
            ahead_by = F.col("__ahead")
        if heads:
            edges["__head"] = [heads[c][0] if c in heads else None for c in range(n_chunks)]
            counts["__back"] = [backward(c) if c in heads else 0 for c in range(n_chunks)]
            in_head = position.crosses(F.col("__head")) & (position.row <= F.col("__head"))
            back_by = F.col("__back")
        target = F.explode(
            F.sequence(
                here - F.when(in_head, back_by).otherwise(zero),
                here + F.when(in_tail, ahead_by).otherwise(zero),
            )
        ).alias("__target")
        return (
            position.by_chunk(self._df, edges, counts)
            .select(*data, _CHUNK, target)
            .withColumn(_HALO, F.col("__target") != F.col(_CHUNK))
            .select(*data, F.col("__target").alias(_CHUNK), _HALO)
        )

    # -- unbounded reach --------------------------------------------------------------

    def forward_fill(self, cols: Sequence[str]) -> OrderedFrame:
        """Replace nulls by the previous non-null value."""
        return self._fill(cols, backward=False)

    def backward_fill(self, cols: Sequence[str]) -> OrderedFrame:
        """Replace nulls by the next non-null value; trailing nulls stay.

        Runs as a growing frame over the reversed order: Spark evaluates frames that end
        at UNBOUNDED FOLLOWING in quadratic time.
        """
        return self._fill(cols, backward=True)

    def _fill(self, cols: Sequence[str], backward: bool) -> OrderedFrame:
        cols = list(cols)
        if not cols:
            return self
        me = self._settled(cols)
        grow = me._window(descending=backward).rowsBetween(Window.unboundedPreceding, 0)
        filled = {c: F.last(c, ignorenulls=True).over(grow).alias(c) for c in cols}
        out = me._df.select(*[filled.get(c, c) for c in me._df.columns])
        if not me.chunked:
            return me._next(out, cols)
        order = F.struct(*me.spec.order_by)
        pick = F.min_by if backward else F.max_by
        aggs = [pick(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
        carry = me._carry(aggs, cols, lambda c, w: F.last(c, ignorenulls=True).over(w), backward)
        out = me._join_carry(out, carry, cols)
        merged = {c: F.coalesce(F.col(c), F.col(f"__in_{c}")).alias(c) for c in cols}
        return me._next(out.select(*[merged.get(c, F.col(c)) for c in me._df.columns]), cols)

    def row_index(self, name: str = "index") -> OrderedFrame:
        """0-based position within the key (or the whole table without keys)."""
        out = self._df.withColumn(name, (F.row_number().over(self._window()) - 1).cast("bigint"))
        if self.chunked:
            carry = self._carry([F.count(F.lit(1)).alias("n")], ["n"], lambda c, w: F.sum(c).over(w))
            out = self._join_carry(out, carry, ["n"])
            out = out.withColumn(name, F.col(name) + F.coalesce("__in_n", F.lit(0))).drop("__in_n")
        return self._next(out, [name])

    def running_sum(self, col: str, name: str) -> OrderedFrame:
        """Sum of ``col`` up to and including the row."""
        me = self._settled([col])
        grow = me._window().rowsBetween(Window.unboundedPreceding, 0)
        out = me._df.withColumn(name, F.sum(col).over(grow))
        if me.chunked:
            carry = me._carry([F.sum(col).alias("s")], ["s"], lambda c, w: F.sum(c).over(w))
            out = me._join_carry(out, carry, ["s"])
            total = F.when(
                F.col(name).isNotNull() | F.col("__in_s").isNotNull(),
                F.coalesce(name, F.lit(0)) + F.coalesce("__in_s", F.lit(0)),
            )
            out = out.withColumn(name, total).drop("__in_s")
        return me._next(out, [name])

    def running_min(self, col: str, name: str) -> OrderedFrame:
        """Smallest value up to and including the row."""
        me = self._settled([col])
        grow = me._window().rowsBetween(Window.unboundedPreceding, 0)
        out = me._df.withColumn(name, F.min(col).over(grow))
        if me.chunked:
            carry = me._carry([F.min(col).alias("m")], ["m"], lambda c, w: F.min(c).over(w))
            out = me._join_carry(out, carry, ["m"])
            out = out.withColumn(name, F.least(name, "__in_m")).drop("__in_m")
        return me._next(out, [name])

    def _carry(self, aggs: list[Column], cols: list[str], combine, backward: bool = False) -> DataFrame:
        """(chunk, keys, __in_*): what the chunks before (after) hand to this chunk.

        Only rows of keys that cross a boundary count, so there is at most one row per
        chunk; they are map-side aggregated and the small table is windowed per key.
        """
        keys = list(self.spec.partition_by)
        rows = self._base
        if keys:
            rows = _only_crossing_keys(rows, self.spec, self._ranges, upper=not backward)
        part = rows.groupBy(_CHUNK, *keys).agg(*aggs)
        step = -1 if backward else 1
        w = (
            Window.partitionBy(*keys)
            .orderBy(F.col(_CHUNK).desc() if backward else F.col(_CHUNK))
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        # Boundaries are rows of the table, so a key that goes on through a chunk always
        # has rows there: the chain of carried rows has no holes.
        return part.select(
            (F.col(_CHUNK) + step).alias(_CHUNK), *keys, *[combine(c, w).alias(f"__in_{c}") for c in cols]
        )

    def _join_carry(self, df: DataFrame, carry: DataFrame, cols: list[str]) -> DataFrame:
        keys = list(self.spec.partition_by)
        c = F.broadcast(carry).alias("carry")  # one row per chunk
        on = F.col(f"main.{_CHUNK}") == F.col(f"carry.{_CHUNK}")
        for k in keys:
            on = on & F.col(f"main.{k}").eqNullSafe(F.col(f"carry.{k}"))
        return (
            df.alias("main")
            .join(c, on, "left")
            .select("main.*", *[F.col(f"carry.__in_{x}").alias(f"__in_{x}") for x in cols])
        )


# -- helpers ------------------------------------------------------------------------


class _Position:
    """Keys and order of a row as one comparable struct, and constants of that type.

    Timestamps become microseconds, so that a value read to the driver and written into a
    plan is the same in every time zone. Constants are folded into one literal array that
    every task refers to: nothing is joined, and no array is copied per row. Layouts of more
    than ``LITERALS`` chunks join a broadcast table of one row per chunk instead.
    """

    def __init__(self, df: DataFrame, spec: SeriesSpec):
        self.n_keys = len(spec.partition_by)
        self.names = [f"p{i}" for i in range(len(spec.columns))]
        self.columns = [_comparable(df, c).alias(n) for c, n in zip(spec.columns, self.names)]
        self.row = F.struct(*self.columns)
        fields = df.select(*self.columns).schema.fields
        self.type = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def constant(self, rows: list) -> Column:
        """Array literal of positions; None entries are null."""
        data = [None if r is None else dict(zip(self.names, r)) for r in rows]
        return F.from_json(F.lit(json.dumps(data, default=str)), T.ArrayType(self.type))

    def by_chunk(self, df: DataFrame, edges: dict[str, list], counts: dict[str, list[int]] | None = None) -> DataFrame:
        """``df`` and, by name, its chunk's entry of lists of positions and of numbers."""
        lists = {**edges, **(counts or {})}
        if not lists:
            return df
        if max(map(len, lists.values())) <= LITERALS:
            here = F.col(_CHUNK)
            found = {n: F.get(self.constant(x), here) for n, x in edges.items()}
            return df.withColumns(found | {n: F.get(_int_constant(x), here) for n, x in (counts or {}).items()})
        fields = [T.StructField(n, self.type if n in edges else T.IntegerType()) for n in lists]
        rows = [(i, *entry) for i, entry in enumerate(zip(*lists.values(), strict=True))]
        schema = T.StructType([T.StructField("__number", T.IntegerType()), *fields])
        table = df.sparkSession.createDataFrame(rows, schema)
        # One row per chunk of max_rows rows.
        return df.join(F.broadcast(table), F.col(_CHUNK) == F.col("__number"), "left").drop("__number")

    def crosses(self, edge: Column) -> Column:
        """The row has the key of ``edge`` (a possibly null position)."""
        hit = edge.isNotNull()
        for here, name in zip(self.columns[: self.n_keys], self.names):
            hit = hit & here.eqNullSafe(edge[name])
        return hit


def _int_constant(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def _comparable(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    return F.col(c)


def _choose_ranges(df: DataFrame, spec: SeriesSpec) -> list | None:
    """Boundary rows of a chunked layout, or None for the plain one."""
    if spec.mode == "plain":
        return None
    n = df.count()
    if n <= spec.max_rows and spec.mode == "auto":
        return None
    chunks = max(2, -(-n // spec.max_rows))
    fraction = min(1.0, SAMPLES_PER_CHUNK * chunks / max(n, 1))
    position = _Position(df, spec)
    sample = df.select(*position.columns).sample(fraction, seed=42)
    if chunks <= LITERALS:
        rows = [tuple(r) for r in sample.orderBy(*position.names).collect()]
        borders = [rows[i * len(rows) // chunks] for i in range(1, chunks)] if rows else []
    else:
        borders = _every(sample, position.names, max(1, int(fraction * n / chunks)))
    ranges: list = []
    for row in borders:
        # One NaN object: tuples that hold the same one are equal.
        row = tuple(math.nan if isinstance(v, float) and math.isnan(v) else v for v in row)
        if not ranges or row != ranges[-1]:
            ranges.append(row)
    if spec.mode == "auto" and spec.partition_by:
        starts = [r[: len(spec.partition_by)] for r in ranges]
        if all(a != b for a, b in zip(starts, starts[1:])):
            return None  # no key fills a whole chunk: plain windows are balanced
    return ranges


def _every(sample: DataFrame, names: list[str], k: int) -> list:
    """Each ``k``-th row of a large sample in order; only these reach the driver.

    The sample is a series itself, so its rows are numbered in the layout its size asks for.
    """
    numbered = OrderedFrame(materialize(sample), SeriesSpec(tuple(names))).row_index("__i").df
    kept = numbered.where((F.col("__i") % k == 0) & (F.col("__i") > 0)).orderBy("__i")
    return [tuple(r) for r in kept.select(*names).collect()]


def _tag(df: DataFrame, spec: SeriesSpec, ranges: list) -> DataFrame:
    """Add the chunk number: how many boundaries are <= the row.

    Beyond ``LITERALS`` boundaries the row is first placed between every so manyth of them;
    the boundaries of that stretch then come from a broadcast table.
    """
    if len(ranges) <= LITERALS:
        return _tag_by_literals(df, spec, ranges)
    step = -(-len(ranges) // LITERALS)
    position = _Position(df, spec)
    stretches = [(i // step + 1, i + 1, [dict(zip(position.names, r)) for r in ranges[i + 1 : i + step]]) for i in range(0, len(ranges), step)]
    schema = T.StructType(
        [T.StructField("__stretch", T.IntegerType()), T.StructField("__low", T.IntegerType()), T.StructField("__borders", T.ArrayType(position.type))]
    )
    table = df.sparkSession.createDataFrame(stretches, schema)
    coarse = _tag_by_literals(df, spec, ranges[::step])
    # All boundaries, one for max_rows rows, in at most LITERALS rows.
    found = coarse.join(F.broadcast(table), F.col(_CHUNK) == F.col("__stretch"), "left")
    inside = _search(F.col("__borders"), position.row, F.lit(0), F.size("__borders"), step)
    chunk = F.when(F.col("__stretch").isNull(), 0).otherwise(F.col("__low") + inside)
    return found.select(*df.columns, chunk.alias(_CHUNK))


def _tag_by_literals(df: DataFrame, spec: SeriesSpec, ranges: list) -> DataFrame:
    """Add the chunk number.

    A numeric first column is looked up in a sorted array; only rows that share its value
    with a boundary (the hot keys) are compared as a whole, by binary search.
    """
    position = _Position(df, spec)
    borders = position.constant(ranges)
    first = position.columns[0].cast("double")
    numeric = isinstance(position.type[0].dataType, T.NumericType)
    heads = [None if r[0] is None else float(r[0]) for r in ranges] if numeric else []
    values = sorted({h for h in heads if h is not None})
    if not values or not all(math.isfinite(v) for v in values):
        chunk = _search(borders, position.row, F.lit(0), F.lit(len(ranges)), len(ranges))
        return df.withColumn(_CHUNK, chunk)
    below = [0] + [sum(h is None or h < v for h in heads) for v in values]
    upto = [heads.count(None)] + [b + heads.count(v) for b, v in zip(below[1:], values)]
    widest = max(b - a for a, b in zip(below, upto))
    lookup = Bucketizer(
        splits=[float("-inf"), *values, float("inf")], inputCol="__first", outputCol="__at", handleInvalid="keep"
    )
    # Nulls sort first, NaN last, as in the boundaries.
    last = float("inf")
    named = df.withColumn("__first", F.when(F.isnan(first), last).otherwise(F.coalesce(first, F.lit(float("-inf")))))
    at = F.col("__at").cast("int")
    low, high = F.get(_int_constant(below), at), F.get(_int_constant(upto), at)
    value = F.get(F.from_json(F.lit(json.dumps([None, *values])), "array<double>"), at)
    # Bucket 0 lies before all values: only null boundaries can be at or before its rows.
    same = F.when(at == 0, F.col("__first") == float("-inf")).otherwise(F.col("__first") == value)
    chunk = F.when(same, _search(borders, position.row, low, high, widest)).otherwise(high)
    return lookup.transform(named).select(*df.columns, chunk.alias(_CHUNK))


def _search(borders: Column, me: Column, low: Column, high: Column, widest: int) -> Column:
    """Number of boundaries <= ``me``, known to lie in [low, high]."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        return (
            F.when(acc["lo"] >= acc["hi"], acc)
            .when(
                F.get(borders, mid) <= acc["me"],
                F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"), acc["me"].alias("me")),
            )
            .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"), acc["me"].alias("me")))
        )

    start = F.struct(low.alias("lo"), high.alias("hi"), me.alias("me"))
    steps = F.array(*[F.lit(i) for i in range(widest.bit_length())])
    return F.aggregate(steps, start, halve, lambda acc: acc["lo"])


def _only_crossing_keys(df: DataFrame, spec: SeriesSpec, ranges: list, upper: bool) -> DataFrame:
    """Rows whose key goes on into the next (``upper``) or began in an earlier chunk."""
    position = _Position(df, spec)
    edges = [*ranges, None] if upper else [None, *ranges]
    return position.by_chunk(df, {"__border": edges}).where(position.crosses(F.col("__border"))).drop("__border")


def _edge_rows(narrow: DataFrame, spec: SeriesSpec, ranges: list, reach: int, last: bool) -> dict:
    """Per chunk, the ``reach``-th row from its end (start) of the crossing key, and how many
    such rows there are up to ``reach``. Only ``reach`` rows per chunk and task are shuffled.
    """
    rows = narrow
    if spec.partition_by:
        rows = _only_crossing_keys(narrow, spec, ranges, upper=last)
    order = [F.col(c).desc() if last else F.col(c).asc() for c in spec.order_by]
    w = Window.partitionBy(_CHUNK).orderBy(*order)
    near = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= reach)
    me = _Position(narrow, spec).row
    edge = (F.min(me) if last else F.max(me)).alias("edge")
    found = near.groupBy(_CHUNK).agg(edge, F.count(F.lit(1)).alias("n")).collect()
    return {r[_CHUNK]: (tuple(r["edge"]), r["n"]) for r in found}
