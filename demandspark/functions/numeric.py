"""Numeric helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# From 2**53 / 100 on, a double has no cents to round; also keeps floor() inside bigint.
_ROUND_LIMIT = 9.0e13
_SPLIT = 134217729.0  # 2**27 + 1: splits a double into two halves of 26 bits


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, the rule of column expressions.

    Values too large to have decimals, NaN and infinities pass.
    """
    scale = float(10**digits)
    x = x.cast("double")
    return F.when(
        F.abs(x) < F.lit(_ROUND_LIMIT / max(1.0, scale / 100)),
        F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale),
    ).otherwise(x)


def round_product(x: Column, digits: int = 2) -> Column:
    """rint(x * 10^d) / 10^d, the rule of array libraries: ties of the product go to even."""
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale


def round2(x: Column) -> Column:
    """Round at 2 decimals by the exact binary value, ties to even, as Python's ``round``.

    3550.5 * 0.91 lies a hair below 3230.955 and gives 3230.95; multiplying by 100 first
    would hide that. The candidate from floor() is compared with the exact 200 * x, built
    from two halves of x whose products have no rounding error. Uses ``x`` several times:
    pass a column rather than a long expression.
    """
    x = x.cast("double")
    a = F.abs(x)
    c = F.floor(a * F.lit(100.0) + F.lit(0.5)).cast("double")
    hi = a * F.lit(_SPLIT) - (a * F.lit(_SPLIT) - a)
    over = (F.lit(200.0) * hi - (F.lit(2.0) * c - F.lit(1.0))) + F.lit(200.0) * (a - hi)
    cents = c - F.when(over > 0, F.lit(0.0)).when(over < 0, F.lit(1.0)).otherwise(c % 2)
    return F.when(a < F.lit(_ROUND_LIMIT), F.signum(x) * cents / F.lit(100.0) + F.lit(0.0)).otherwise(x)


def with_rounded(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns rounded by :func:`round2`.

    The values become columns first, so the rounding refers to them by name instead of
    repeating their expressions; plans stay small however long the rules are.
    """
    raw = {f"__raw_{n}": c.cast("double") for n, c in cols.items()}
    out = df.withColumns(raw).withColumns({n: round2(F.col(f"__raw_{n}")) for n in cols})
    return out.drop(*raw)


def round6(x: Column) -> Column:
    return round_half_up(x, 6)


def clip(x: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Limit to [lo, hi]; null stays null (``least``/``greatest`` skip nulls)."""
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNotNull(), out)


def membership_flag(x: Column, values: list) -> Column:
    """1 when ``x`` is one of ``values``, else 0, as tinyint; null stays null."""
    return x.isin(*values).cast("tinyint")


def above_flag(x: Column, threshold: float | Column) -> Column:
    """1 when ``x`` > threshold, else 0, as tinyint."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (x > t).cast("tinyint")


def interaction(a: str, b: str, operation: str) -> Column:
    """Sum or product of two columns, named after both."""
    if operation == "add":
        return (F.col(a) + F.col(b)).alias(f"{a}_plus_{b}")
    if operation == "multiply":
        return (F.col(a) * F.col(b)).alias(f"{a}_times_{b}")
    raise ValueError(f"operation must be 'add' or 'multiply', got {operation!r}")


def percent_change(old: Column, new: Column) -> Column:
    """(new - old) / old * 100; an old value of 0 gives infinity."""
    return F.when(old == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(new - old, old) * F.lit(100.0)
    )


def strength_label(r: Column) -> Column:
    """Class of a correlation by sign and size; 0 counts as negative."""
    size = F.abs(r)
    level = (
        F.when(size > 0.7, F.lit("very_strong"))
        .when(size > 0.5, F.lit("strong"))
        .when(size > 0.3, F.lit("moderate"))
        .otherwise(F.lit("weak"))
    )
    sign = F.when(r > 0, F.lit("positive")).otherwise(F.lit("negative"))
    return F.when(r.isNotNull(), F.concat_ws("_", sign, level))
