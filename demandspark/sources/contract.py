"""Input contract of the hourly request: bounds, allowed currencies, entry rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.numeric import round2

# Inclusive bounds; None = open.
BOUNDS: dict[str, tuple[float, float | None]] = {
    "season": (1, 4),
    "mnth": (1, 12),
    "holiday": (0, 1),
    "hr": (0, 23),
    "weekday": (0, 6),
    "workingday": (0, 1),
    "weathersit": (1, 4),
    "temp": (0, 1),
    "hum": (0, 1),
    "windspeed": (0, 1),
    "cnt": (0, None),
}
CURRENCIES = ["NGN", "USD"]
ROUNDED = ["temp", "hum", "windspeed"]


def check(df: DataFrame, name: str = "violations") -> DataFrame:
    """Add the names of columns that are missing a value or out of bounds, in one projection."""
    tests = []
    for c, (lo, hi) in BOUNDS.items():
        x = F.col(c)
        bad = x.isNull() | (x < lo)
        if hi is not None:
            bad = bad | (x > hi)
        tests.append(F.when(bad, F.lit(c)))
    if "currency" in df.columns:
        known = F.col("currency").isNull() | F.col("currency").isin(*CURRENCIES)
        tests.append(F.when(~known, F.lit("currency")))
    return df.withColumn(name, F.array_compact(F.array(*tests)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``violations``)."""
    checked = check(df)
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def round_inputs(df: DataFrame) -> DataFrame:
    """Fractional inputs to 2 dp, as on entry of a request."""
    return df.withColumns({c: round2(F.col(c)) for c in ROUNDED})
