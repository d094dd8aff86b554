"""Temporal splits, expanding-window folds and row union.

Splits find the *row value* at a boundary position once, then filter on it: the parts
are plain filters of the source, and the first order column's bound reaches the scan. A position is
found by value: one scan counts the rows and sketches the first order column, one counts the rows
before and in the bracket around the position, and only the bracket's rows are put in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators.ordered import OrderedFrame, SeriesSpec
from demandspark.operators.quantiles import SKETCH_MARGIN, staged_sketches
from demandspark.session import materialize

#: Rows that are put in order in one task to find a position.
SORTED_ROWS = 200_000
SPLIT = "split"
TIE = "__tie"


def split_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int]:
    """(num_train, num_val) before the inclusive bounds are applied."""
    if not 0.0 <= test_size <= 1.0 or not 0.0 <= val_size <= 1.0:
        raise ValueError("a share of the rows lies in [0, 1]")
    if test_size + val_size >= 1.0:
        raise ValueError("validation and test shares leave no rows to train on")
    return int((1 - test_size - val_size) * n), int(val_size * n)


def add_row_index(df: DataFrame, spec: SeriesSpec, name: str = "index") -> DataFrame:
    """0-based row position in series order, per key if the series has keys."""
    return OrderedFrame(df, spec).row_index(name).df


def rows_between(df: DataFrame, after: int | None, upto: int | None, index: str = "index") -> DataFrame:
    """Rows with after < index <= upto."""
    if after is not None:
        df = df.where(F.col(index) > after)
    return df if upto is None else df.where(F.col(index) <= upto)


def _unkeyed(spec: SeriesSpec) -> None:
    if spec.partition_by:
        raise ValueError("a temporal split runs over one time axis: use a spec without keys")


def _literal(value, dtype: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(str(value)).cast(dtype)
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value).cast("bigint"))
    return F.lit(value).cast(dtype)


def _numeric(df: DataFrame, c: str) -> Column | None:
    """The column as a double in its own order, if its type has one."""
    dtype = df.schema[c].dataType
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.col(c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c)).cast("double")
    return None


@dataclass(frozen=True)
class _Survey:
    """Rows, nulls and NaNs of a table in one column, and a sketch of its other values."""

    n: int
    nulls: int = 0
    nans: int = 0
    sketch: bytes | None = None


def _survey(df: DataFrame, c: str) -> _Survey:
    """One scan of one column; no sketch if its type has no numbers."""
    x = _numeric(df, c)
    if x is None:
        return _Survey(df.count())
    real = F.when(x.isNotNull() & ~F.isnan(x), x)
    counts = [F.count(F.lit(1)), F.count_if(x.isNull()), F.coalesce(F.count_if(F.isnan(x)), F.lit(0))]
    row = staged_sketches(df, [real], counts).first()
    return _Survey(row["c0"], row["c1"], row["c2"], bytes(row["k0"]) if row["k0"] is not None else None)


def _bounds(df: DataFrame, c: str, low: float, high: float) -> Column:
    """low <= column <= high as numbers, and in the column's own type where that can reach the scan."""
    x, dtype = _numeric(df, c), df.schema[c].dataType
    inside = (x >= F.lit(low)) & (x <= F.lit(high))
    own = {T.DateType: lambda v: F.date_from_unix_date(F.lit(v)), T.TimestampType: lambda v: F.timestamp_micros(F.lit(v))}.get(type(dtype))
    if isinstance(dtype, T.IntegralType):
        own = lambda v: F.lit(v).cast(dtype)
    if own is not None and max(abs(low), abs(high)) < 2**53:
        inside = inside & (F.col(c) >= own(math.floor(low))) & (F.col(c) <= own(math.ceil(high)))
    return inside


def _brackets(df: DataFrame, c: str, known: _Survey, ranks: list[int], margin: float = SKETCH_MARGIN) -> list[tuple[DataFrame, int, int, bool]]:
    """For each rank a part of the rows that holds its row, how many rows come before the part, how
    many it has, and whether all its values of the column are equal. One more scan for all ranks."""
    x, real = _numeric(df, c), known.n - known.nulls - known.nans
    inner = [r for r in ranks if known.nulls <= r < known.n - known.nans]
    ends: dict[int, tuple[float, float]] = {}
    if inner:
        sketch = df.sparkSession.createDataFrame([(bytearray(known.sketch),)], "k binary")
        places = [(r - known.nulls) / max(real - 1, 1) for r in inner]
        values = [F.kll_sketch_get_quantile_double("k", F.lit(min(1.0, max(0.0, p + e)))) for p in places for e in (-margin, margin)]
        row = sketch.select(*[v.alias(f"q{i}") for i, v in enumerate(values)]).first()
        ends = {r: (row[2 * i], row[2 * i + 1]) for i, r in enumerate(inner)}
    counts = [f for a, b in ends.values() for f in (F.count_if(x < F.lit(a)), F.count_if((x >= F.lit(a)) & (x <= F.lit(b))))]
    got = df.agg(*[f.alias(f"n{i}") for i, f in enumerate(counts)]).first() if counts else ()
    found = {r: (known.nulls + got[2 * i], got[2 * i + 1]) for i, r in enumerate(ends)}
    out = []
    for r in ranks:
        if r < known.nulls:
            out.append((df.where(F.col(c).isNull()), 0, known.nulls, True))
        elif r >= known.n - known.nans:
            out.append((df.where(F.isnan(x)), known.n - known.nans, known.nans, True))
        else:
            (a, b), (before, size) = ends[r], found[r]
            if before <= r < before + size:
                # Whole numbers beyond 2^53 can share a double; their order is left to the sort.
                out.append((df.where(_bounds(df, c, a, b)), before, size, a == b and abs(a) < 2**53))
            else:
                out += _brackets(df, c, known, [r], 4 * margin)
    return out


def _row_at(df: DataFrame, order: list[str], shown: list[Column], rank: int, known: _Survey):
    """The row at a position: brackets of values are narrowed, in the first column and then in the
    next ones, until ``SORTED_ROWS`` rows or fewer are left to be put in order."""
    rest = list(order)
    while known.n > SORTED_ROWS and rest:
        if known.sketch is None and _numeric(df, rest[0]) is None:
            # Text has no number to be bracketed by.
            return OrderedFrame(df, SeriesSpec(tuple(order))).row_index("__i").df.where(F.col("__i") == rank).select(*shown).first()
        ((df, before, size, equal),) = _brackets(df, rest[0], known, [rank])
        rank -= before
        if equal:
            rest = rest[1:]
        elif size == known.n:
            # Nothing more to narrow.
            break
        known = _survey(df, rest[0]) if size > SORTED_ROWS and rest else _Survey(size)
    if not rest:
        return df.select(*shown).first()
    # The last of the rows up to the rank: each task keeps no more than these.
    last = df.orderBy(*order).limit(rank + 1).select(F.max(F.struct(*order)).alias("top"))
    return last.select("top.*").select(*shown).first()


def _positions(df: DataFrame, spec: SeriesSpec, known: _Survey, ranks: list[int]) -> dict[int, list[Column]]:
    """Order values (as literals) of the rows at the given positions. Rows are never numbered."""
    rows, order = df.select(*spec.order_by), list(spec.order_by)
    types = {c: df.schema[c].dataType for c in order}
    shown = [F.unix_micros(c).alias(c) if isinstance(t, T.TimestampType) else F.col(c) for c, t in types.items()]
    ranks = [r for r in ranks if r < known.n]
    parts = [(rows, 0, known)] * len(ranks)
    if known.n > SORTED_ROWS and _numeric(df, order[0]) is not None and ranks:
        found = _brackets(rows, order[0], known, ranks)
        parts = [(part, before, _survey(part, order[0]) if size > SORTED_ROWS else _Survey(size)) for part, before, size, _ in found]
    out = {}
    for r, (part, before, inner) in zip(ranks, parts):
        row = _row_at(part, order, shown, r - before, inner)
        out[r] = [_literal(row[c], t) for c, t in types.items()]
    return out


def _upto(spec: SeriesSpec, at: list[Column]) -> Column:
    """Row is at or before a position in series order: nulls first, NaN last, never null.

    The bound on the first column can be pushed down.
    """
    first = F.col(spec.order_by[0])
    bound = first.isNull() | F.coalesce(first <= at[0], F.lit(False))
    if len(at) == 1:
        return bound
    me = F.struct(*[F.col(c) for c in spec.order_by])
    border = F.struct(*[v.alias(c) for v, c in zip(at, spec.order_by)])
    return bound & (me <= border)


def _heads(df: DataFrame, spec: SeriesSpec, at: dict[int, list[Column]]) -> tuple[DataFrame, dict[int, Column]]:
    """For each position r, a test that holds for exactly the rows at positions 0 to r.

    Rows before the order values at r all pass, and of the rows equal to them as many as the
    count needs. Only if such a tie spans a position are the rows written once with a number
    (column ``TIE``), and the tied rows up to the right number pass; drop it afterwards.
    """
    me = F.struct(*[F.col(c) for c in spec.order_by])
    equal = {r: me.eqNullSafe(F.struct(*[v.alias(c) for v, c in zip(vals, spec.order_by)])) for r, vals in at.items()}
    upto = {r: _upto(spec, vals) for r, vals in at.items()}
    if not at:
        return df, {}
    counts = [f for r in at for f in (F.count_if(upto[r] & ~equal[r]), F.count_if(equal[r]))]
    got = df.agg(*[f.alias(f"n{i}") for i, f in enumerate(counts)]).first()
    wanted = {r: r + 1 - got[2 * i] for i, r in enumerate(at)}
    split = [r for i, r in enumerate(at) if wanted[r] < got[2 * i + 1]]
    if not split:
        return df, upto
    df = materialize(df.withColumn(TIE, F.monotonically_increasing_id()))
    heads = dict(upto)
    for r in split:
        tied = df.where(equal[r]).select(TIE)
        (last,) = _positions(tied, SeriesSpec((TIE,)), _survey(tied, TIE), [wanted[r] - 1])[wanted[r] - 1]
        heads[r] = (upto[r] & ~equal[r]) | (equal[r] & (F.col(TIE) <= last))
    return df, heads


def label_split(df: DataFrame, spec: SeriesSpec, test_size: float = 0.2, val_size: float = 0.2) -> DataFrame:
    """Add ``split`` = train / val / test; bounds are inclusive, so train has one row more."""
    _unkeyed(spec)
    split_sizes(0, test_size, val_size)
    known = _survey(df, spec.order_by[0])
    n_train, n_val = split_sizes(known.n, test_size, val_size)
    at = _positions(df, spec, known, [n_train, n_train + n_val])
    df, heads = _heads(df, spec, at)
    label = F.lit("test")
    if n_train + n_val in heads:
        label = F.when(heads[n_train + n_val], F.lit("val")).otherwise(label)
    else:
        label = F.lit("val")
    if n_train in heads:
        label = F.when(heads[n_train], F.lit("train")).otherwise(label)
    else:
        label = F.lit("train")
    return df.withColumn(SPLIT, label).drop(TIE)


def split_train_val_test(
    df: DataFrame, spec: SeriesSpec, test_size: float = 0.2, val_size: float = 0.2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three parts in time order."""
    labelled = label_split(df, spec, test_size, val_size)
    return tuple(
        labelled.where(F.col(SPLIT) == part).drop(SPLIT) for part in ("train", "val", "test")
    )


def label_two_way(df: DataFrame, spec: SeriesSpec, test_size: float = 0.2) -> DataFrame:
    """Add ``split``: the first int((1 - test_size) * n) rows are train, the rest test."""
    _unkeyed(spec)
    if not 0.0 <= test_size <= 1.0:
        raise ValueError("a share of the rows lies in [0, 1]")
    known = _survey(df, spec.order_by[0])
    n_train = int((1 - test_size) * known.n)
    if n_train == 0:
        return df.withColumn(SPLIT, F.lit("test"))
    at = _positions(df, spec, known, [n_train - 1])
    df, heads = _heads(df, spec, at)
    return df.withColumn(
        SPLIT, F.when(heads[n_train - 1], F.lit("train")).otherwise(F.lit("test"))
    ).drop(TIE)


def fold_bounds(n: int, n_splits: int, test_size: int) -> list[tuple[int, int, int]]:
    """(fold, train_end, test_end): train is [0, train_end), test [train_end, test_end)."""
    if n - n_splits * test_size <= 0:
        raise ValueError(f"{n} rows are too few for {n_splits} folds of {test_size} test rows")
    return [
        (i, n - (n_splits - i) * test_size, n - (n_splits - i - 1) * test_size)
        for i in range(n_splits)
    ]


def expanding_folds(
    df: DataFrame, spec: SeriesSpec, n_splits: int = 3, test_size: int = 168, index: str = "index"
) -> DataFrame:
    """Long table of expanding-window folds: every row once per fold it belongs to.

    Adds ``fold``, ``role`` (train / test) and the row index. The fold list is a literal
    array of ``n_splits`` entries, so there is no join: one projection multiplies rows.
    """
    _unkeyed(spec)
    bounds = fold_bounds(df.count(), n_splits, test_size)
    indexed = add_row_index(df, spec, index)
    i = F.col(index)
    entries = F.array(
        *[
            F.when(
                i < end,
                F.struct(
                    F.lit(f).alias("fold"),
                    F.when(i < start, F.lit("train")).otherwise(F.lit("test")).alias("role"),
                ),
            )
            for f, start, end in bounds
        ]
    )
    out = indexed.withColumn("__f", F.explode(F.array_compact(entries)))
    return out.select(F.col("__f.fold").alias("fold"), F.col("__f.role").alias("role"), *indexed.columns)


def combine_rows(train: DataFrame, val: DataFrame) -> DataFrame:
    """Stack two tables that have the same columns."""
    if set(train.columns) != set(val.columns):
        odd = sorted(set(train.columns) ^ set(val.columns))
        raise ValueError(f"columns differ between the tables: {odd}")
    return train.unionByName(val)
