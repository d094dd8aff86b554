"""Pricing rules as column expressions.

Each rule returns its value, or null where an input breaks the rule's contract;
``price_columns`` collects the reasons in ``error`` (policy "null") or stops the job
(policy "fail"). Numbers below are fixed values of the pricing model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandspark.config import BusinessConfig
from demandspark.functions.numeric import clip, round2, round_half_up, round_product

# Unit ranges of the normalised weather inputs.
TEMP_MIN, TEMP_MAX = -8.0, 39.0
WIND_FACTOR = 0.8507

# Weather factor weights and limits.
WEATHER_BASE = 0.4
WEATHER_WEIGHTS = {"temp": 0.25, "hum": 0.1, "windspeed": 0.16, "weathersit": 0.33}
WEATHER_LIMITS = (0.85, 1.48)

# Time-of-day factors.
PEAK_HOURS = [7, 8, 9, 16, 17, 18]
BUSINESS_HOURS = [10, 11, 12, 13, 14, 15, 19, 20]
PEAK_FACTOR, BUSINESS_FACTOR, QUIET_FACTOR = 1.48, 1.30, 0.92

# Sensitivities and limits of the multiplier.
ELASTICITY_ALPHA = 0.6
COMPETITOR_ALPHA = 0.45
COMPETITOR_LIMITS = (0.85, 1.5)
SURGE_K = 0.662

# Competitor score (hours weighted higher, and weights in summing order).
COMPETITOR_PEAK_HOURS = [7, 8, 9, 17, 18, 19]
COMPETITOR_INPUTS = [
    "mnth",
    "holiday",
    "hr",
    "weekday",
    "workingday",
    "weathersit",
    "temp",
    "hum",
    "windspeed",
    "cnt",
]
COMPETITOR_WEIGHTS = {
    "mnth": 0.04,
    "holiday": 0.05,
    "hr": 0.15,
    "weekday": 0.05,
    "workingday": 0.1,
    "weathersit": 0.12,
    "temp": 0.06,
    "hum": 0.02,
    "windspeed": 0.02,
    "cnt": 0.16,
}


def celsius(t_norm: Column, t_min: float = TEMP_MIN, t_max: float = TEMP_MAX) -> Column:
    """Normalised temperature to degrees Celsius."""
    return t_norm * F.lit(t_max - t_min) + F.lit(t_min)


def wind_speed(w_norm: Column, factor: float = WIND_FACTOR) -> Column:
    """Normalised wind speed to the original unit."""
    return w_norm * F.lit(factor)


def _classes(x: Column, rules: list[tuple[Column, int]], default: int) -> Column:
    out = F
    for cond, cls in rules:
        out = out.when(cond, F.lit(cls))
    return F.when(x.isNotNull(), out.otherwise(F.lit(default))).cast("tinyint")


def temperature_class(temp_c: Column) -> Column:
    """1 (best) .. 4; values in the gaps between bands fall to 4."""
    x = round_product(temp_c)
    return _classes(
        x,
        [
            ((x < 0) | (x > 35), 4),
            (x.between(0, 9) | x.between(30, 35), 3),
            (x.between(21, 29), 2),
            (x.between(10, 20), 1),
        ],
        default=4,
    )


def humidity_class(hum: Column) -> Column:
    x = round_product(hum)
    return _classes(
        x,
        [
            (x > 0.8, 4),
            (x < 0.2, 3),
            (x.between(0.2, 0.39) | x.between(0.61, 0.8), 2),
            (x.between(0.4, 0.6), 1),
        ],
        default=4,
    )


def wind_class(wind: Column) -> Column:
    """Gaps and negative speeds count as class 1."""
    x = round_product(wind)
    return _classes(
        x, [(x > 50, 4), (x.between(26, 50), 3), (x.between(16, 25), 2)], default=1
    )


def weather_columns(
    temp: str = "temp", hum: str = "hum", windspeed: str = "windspeed", weathersit: str = "weathersit"
) -> dict[str, Column]:
    """The four weather classes of a row, from its normalised readings."""
    return {
        "temp_class": temperature_class(celsius(F.col(temp))),
        "hum_class": humidity_class(F.col(hum)),
        "wind_class": wind_class(wind_speed(F.col(windspeed))),
        "weather_class": F.col(weathersit).cast("tinyint"),
    }


def weather_raw(temp: Column, hum: Column, wind: Column, sit: Column) -> Column:
    """Combined weather value of four classes before rounding; null when one is outside 1..4."""
    w = WEATHER_WEIGHTS
    ok = temp.between(1, 4) & hum.between(1, 4) & wind.between(1, 4) & sit.between(1, 4)
    base = (
        F.lit(WEATHER_BASE)
        + F.lit(w["temp"]) * temp
        + F.lit(w["hum"]) * hum
        + F.lit(w["windspeed"]) * wind
    ) * (F.lit(w["weathersit"]) * sit)
    lo, hi = WEATHER_LIMITS
    return F.when(ok, F.least(F.greatest(base, F.lit(lo)), F.lit(hi)))


def weather_factor(temp: Column, hum: Column, wind: Column, sit: Column) -> Column:
    return round2(weather_raw(temp, hum, wind, sit))


def elasticity_raw(
    base_elasticity: float | Column, utilization: Column, weather: Column | float = 1.0
) -> Column:
    base = base_elasticity if isinstance(base_elasticity, Column) else F.lit(base_elasticity)
    weather = weather if isinstance(weather, Column) else F.lit(weather)
    value = base * (F.lit(ELASTICITY_ALPHA) * weather + (F.lit(1.0) - utilization))
    return F.when(utilization.between(0.0, 1.0), value)


def dynamic_elasticity(
    base_elasticity: float | Column, utilization: Column, weather: Column | float = 1.0
) -> Column:
    """Elasticity adjusted for utilisation (0..1, else null) and weather."""
    return round2(elasticity_raw(base_elasticity, utilization, weather))


def time_factor(hour: Column) -> Column:
    return F.when(
        hour.between(0, 23),
        F.when(hour.isin(*PEAK_HOURS), F.lit(PEAK_FACTOR))
        .when(hour.isin(*BUSINESS_HOURS), F.lit(BUSINESS_FACTOR))
        .otherwise(F.lit(QUIET_FACTOR)),
    )


def competitor_raw(base_price: Column, competitor_price: Column) -> Column:
    change = F.try_divide(base_price - competitor_price, base_price)
    return F.when(competitor_price >= 0, F.lit(1.0) - F.lit(COMPETITOR_ALPHA) * change)


def competitor_factor(base_price: Column, competitor_price: Column) -> Column:
    """Answer to the competitor's price; null at a base price of 0 or a negative price."""
    return clip(round2(competitor_raw(base_price, competitor_price)), *COMPETITOR_LIMITS)


def utilization(demand: Column, capacity: float | Column) -> Column:
    cap = capacity if isinstance(capacity, Column) else F.lit(float(capacity))
    return F.try_divide(cap - (cap - demand), cap)


def multiplier_raw(comp: Column, util: Column, time: Column, elasticity: Column) -> Column:
    surge = F.lit(1.0) + F.lit(SURGE_K) * util
    value = F.lit(SURGE_K) * comp * surge * time * F.try_divide(F.lit(1.0), F.abs(elasticity))
    return F.when(util <= 1.0, value)


def price_multiplier(comp: Column, util: Column, time: Column, elasticity: Column) -> Column:
    """k * competitor * surge * time / |elasticity|; null above capacity or at elasticity 0."""
    return round2(multiplier_raw(comp, util, time, elasticity))


def price_raw(base_price: Column, multiplier: Column) -> Column:
    return F.when((base_price >= 0) & (multiplier > 0), base_price * multiplier)


def competitor_norms() -> dict[str, Column]:
    """The ten competitor inputs scaled to [0, 1], with their null defaults."""
    c = F.col

    def d(name: str, default: float | None = None) -> Column:
        x = c(name).cast("double")
        return x if default is None else F.coalesce(x, F.lit(float(default)))

    hour_share = (c("hr") % 24).cast("double")
    return {
        "mnth": (d("mnth", 6) - 1) / F.lit(11.0),
        "holiday": d("holiday", 0),
        "hr": F.when(
            F.coalesce(c("hr"), F.lit(12)).isin(*COMPETITOR_PEAK_HOURS),
            F.lit(0.8) + F.lit(0.2) * hour_share / F.lit(23.0),
        ).otherwise(hour_share / F.lit(23.0)),
        "weekday": d("weekday", 3) / F.lit(6.0),
        "workingday": d("workingday", 1),
        "weathersit": F.lit(1.0) - (d("weathersit", 1) - 1) / F.lit(3.0),
        "temp": F.when(d("temp").between(0.6, 0.8), d("temp")).otherwise(d("temp") * F.lit(0.8)),
        "hum": F.lit(1.0) - d("hum", 0.5),
        "windspeed": F.lit(1.0) - d("windspeed", 0.2),
        "cnt": F.least(d("cnt", 200) / F.lit(1000.0), F.lit(1.0)),
    }


def competitor_score(weights: dict[str, float] | None = None) -> Column:
    norms = competitor_norms()
    score: Column = F.lit(0.0)
    for name, weight in (weights or COMPETITOR_WEIGHTS).items():
        score = score + norms[name] * F.lit(weight)
    return score


def competitor_price(
    min_price: float, max_price: float, weights: dict[str, float] | None = None
) -> Column:
    """Score mapped onto the competitor's price range."""
    raw = F.lit(min_price) + competitor_score(weights) * F.lit(max_price - min_price)
    return round_half_up(clip(raw, min_price, max_price), 2)


def rule_errors(cfg: BusinessConfig) -> Column:
    """Names of the broken pricing contracts of a row (empty array = fine)."""
    c = F.col
    checks = [
        (c("weather_class").isNull() | ~c("weather_class").between(1, 4), "weather_class"),
        (c("temp_class").isNull() | c("hum_class").isNull() | c("wind_class").isNull(), "weather_reading"),
        (c("hr").isNull() | ~c("hr").between(0, 23), "hour"),
        (c("demand").isNull() | (c("demand") < 0), "demand"),
        (c("demand") > cfg.max_capacity, "demand_above_capacity"),
        (c("base_price") < 0, "base_price_negative"),
        (c("base_price") == 0, "base_price_zero"),
        (c("competitor_price").isNull() | (c("competitor_price") < 0), "competitor_price"),
        (c("price_multiplier") <= 0, "price_multiplier"),
        (c("elasticity") == 0, "elasticity_zero"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
