"""Pricing jobs: whole tables (or streams) priced in one projection chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.config import BusinessConfig
from demandspark.functions import pricing as rules
from demandspark.functions.numeric import clip, round2, with_rounded

PRICE_COLUMNS = [
    "base_price",
    "price",
    "competitor_price",
    "price_multiplier",
    "surge",
    "discount",
    "min_price",
    "max_price",
    "demand",
    "currency",
]
ON_ERROR = ("null", "fail")


def add_competitor_price(
    df: DataFrame,
    min_price: float,
    max_price: float,
    weights: dict[str, float] | None = None,
    name: str = "competitor_price",
) -> DataFrame:
    """Rule-based competitor price of every row."""
    missing = [c for c in rules.COMPETITOR_INPUTS if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumn(name, rules.competitor_price(min_price, max_price, weights))


def add_weather_factor(df: DataFrame) -> DataFrame:
    """Weather classes and their combined factor."""
    c = F.col
    classed = df.withColumns(rules.weather_columns())
    raw = rules.weather_raw(c("temp_class"), c("hum_class"), c("wind_class"), c("weather_class"))
    return with_rounded(classed, {"weather_factor": raw})


def price_table(
    df: DataFrame,
    config: BusinessConfig | None = None,
    demand: Column | str = "demand",
    base_price: Column | float | None = None,
    base_elasticity: Column | float | None = None,
    currency: Column | str | None = None,
    on_error: str = "null",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Price every row: weather, competitor, multiplier, final price.

    Broken contracts (demand above capacity, hour outside the day, ...) give null prices
    and their names in ``error``; with ``on_error="fail"`` they stop the job. ``keep``
    lists input columns to retain, default all. Works on batch and streaming frames.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    cfg = config or BusinessConfig()
    c = F.col
    lit = lambda v, d: v if isinstance(v, Column) else F.lit(float(d if v is None else v))
    kept = list(df.columns if keep is None else keep)

    out = df.withColumns(
        {
            "demand": (demand if isinstance(demand, Column) else c(demand)).cast("double"),
            "base_price": lit(base_price, cfg.base_price),
            "currency": currency if isinstance(currency, Column) else F.lit(currency or cfg.currency),
            "min_price": F.lit(cfg.min_price),
            "max_price": F.lit(cfg.max_price),
        }
    )
    if "competitor_price" not in df.columns:
        out = add_competitor_price(out, cfg.min_competitor_price, cfg.max_competitor_price)
    out = add_weather_factor(out)
    out = out.withColumn("__util", rules.utilization(c("demand"), cfg.max_capacity))
    base = c("base_price")
    out = with_rounded(
        out,
        {
            "elasticity": rules.elasticity_raw(
                lit(base_elasticity, cfg.base_elasticity), c("__util"), c("weather_factor")
            ),
            "__comp": rules.competitor_raw(base, c("competitor_price")),
        },
    )
    comp = clip(c("__comp"), *rules.COMPETITOR_LIMITS)
    raw = rules.multiplier_raw(comp, c("__util"), rules.time_factor(c("hr")), c("elasticity"))
    out = with_rounded(out, {"price_multiplier": raw})
    out = with_rounded(out, {"price": rules.price_raw(base, c("price_multiplier"))})
    out = out.withColumn("price", clip(c("price"), cfg.min_price, cfg.max_price))
    out = with_rounded(out, {"__delta": c("price") - base})
    delta = c("__delta")
    out = out.withColumns(
        {
            "surge": F.when(delta > 0, delta).when(delta.isNotNull(), F.lit(0.0)),
            "discount": F.when(delta < 0, delta).when(delta.isNotNull(), F.lit(0.0)),
            "error": _error_text(cfg),
        }
    )
    if on_error == "fail":
        out = out.withColumn(
            "price", F.when(c("error").isNull(), c("price")).otherwise(F.raise_error(c("error")).cast("double"))
        )
    extra = [x for x in PRICE_COLUMNS if x not in kept]
    return out.select(*kept, *extra, *(["error"] if on_error == "null" else []))


def _error_text(cfg: BusinessConfig) -> Column:
    errors = rules.rule_errors(cfg)
    return F.when(F.size(errors) > 0, F.array_join(errors, ","))


def add_capacity(df: DataFrame, config: BusinessConfig | None = None, demand: str = "demand") -> DataFrame:
    """Capacity columns of the response: maximum, used, available, rate (2 dp)."""
    cap = (config or BusinessConfig()).max_capacity
    d = F.col(demand)
    return df.withColumns(
        {
            "max_capacity": F.lit(cap).cast("bigint"),
            "current_utilization": d.cast("bigint"),
            "available": (F.lit(cap) - d).cast("bigint"),
            "utilization_rate": round2(d / F.lit(float(cap))),
        }
    )


def response(df: DataFrame, as_json: bool = False) -> DataFrame:
    """One response per priced row: status, capacity, price, timestamp, error."""
    capacity = F.struct("max_capacity", "current_utilization", "available", "utilization_rate")
    price = F.struct(
        "price_multiplier",
        "price",
        "surge",
        "discount",
        "base_price",
        "competitor_price",
        "min_price",
        "max_price",
        "currency",
    )
    body = {
        "status": F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("failed")),
        "capacity_components": F.when(F.col("error").isNull(), capacity),
        "price_components": F.when(F.col("error").isNull(), price),
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
        "error": F.col("error"),
    }
    if as_json:
        return df.select(F.to_json(F.struct(*[v.alias(k) for k, v in body.items()])).alias("response"))
    made = set(body) | set(PRICE_COLUMNS) | {"max_capacity", "current_utilization", "available", "utilization_rate"}
    return df.select(*[c for c in df.columns if c not in made], *[v.alias(k) for k, v in body.items()])


def whole_demand(prediction: Column) -> Column:
    """Model output to a demand: cut decimals, floor at 0."""
    return clip(prediction.cast("bigint"), F.lit(0).cast("bigint"))
