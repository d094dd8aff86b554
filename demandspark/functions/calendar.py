"""Calendar columns and the rule for US federal holidays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_YEAR = 2011


def season(month: Column) -> Column:
    """1 = Mar-May, 2 = Jun-Aug, 3 = Sep-Nov, 4 = Dec-Feb."""
    return (
        F.when(month.isin(3, 4, 5), 1)
        .when(month.isin(6, 7, 8), 2)
        .when(month.isin(9, 10, 11), 3)
        .when(month.isin(12, 1, 2), 4)
        .cast("bigint")
    )


def calendar_columns(ts: Column) -> dict[str, Column]:
    """season, yr (years since 2011, may be negative), mnth, hr, weekday (0 = Monday)."""
    return {
        "season": season(F.month(ts)),
        "yr": (F.year(ts) - F.lit(BASE_YEAR)).cast("bigint"),
        "mnth": F.month(ts).cast("bigint"),
        "hr": F.hour(ts).cast("bigint"),
        "weekday": F.weekday(ts).cast("bigint"),
    }


def working_day(weekday: Column, holiday: Column) -> Column:
    return F.when((weekday < 5) & (holiday == 0), 1).otherwise(0).cast("bigint")


def cyclic_columns() -> dict[str, Column]:
    """Sine and cosine of hour (period 24) and weekday (period 7)."""
    import math

    hour = F.col("hr") * F.lit(2 * math.pi / 24)
    day = F.col("weekday") * F.lit(2 * math.pi / 7)
    return {
        "sin_hour": F.sin(hour),
        "cos_hour": F.cos(hour),
        "sin_weekday": F.sin(day),
        "cos_weekday": F.cos(day),
    }


# Federal holidays. (month, day) dates, or (month, weekday 0 = Monday,
# n-th of the month, -1 = last); last field is the first year of the holiday.
FIXED_DATE_HOLIDAYS = [
    ("New Year's Day", 1, 1, 1871),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1871),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1871),
]
WEEKDAY_HOLIDAYS = [
    ("Martin Luther King Jr. Day", 1, 0, 3, 1986),
    ("Washington's Birthday", 2, 0, 3, 1971),
    ("Memorial Day", 5, 0, -1, 1971),
    ("Labor Day", 9, 0, 1, 1894),
    ("Columbus Day", 10, 0, 2, 1971),
    ("Thanksgiving Day", 11, 3, 4, 1942),
]


def _nth_weekday(day: Column, month: int, weekday: int, nth: int) -> Column:
    in_month = (F.month(day) == month) & (F.weekday(day) == weekday)
    if nth == -1:
        return in_month & (F.month(F.date_add(day, 7)) != month)
    return in_month & (F.ceil(F.dayofmonth(day) / 7) == nth)


def holiday_name(day: Column) -> Column:
    """Name of the federal holiday on a date, else null.

    A fixed-date holiday on a Saturday is also observed on the Friday before, one on a
    Sunday on the Monday after. A pure expression: no dimension table, no join.
    """
    rules: list[tuple[Column, str]] = []
    for name, month, dom, since in FIXED_DATE_HOLIDAYS:
        def on(d: Column, month=month, dom=dom, since=since) -> Column:
            return (F.month(d) == month) & (F.dayofmonth(d) == dom) & (F.year(d) >= since)

        rules.append((on(day), name))
        rules.append((on(F.date_add(day, 1)) & (F.weekday(day) == 4), f"{name} (observed)"))
        rules.append((on(F.date_sub(day, 1)) & (F.weekday(day) == 0), f"{name} (observed)"))
    for name, month, weekday, nth, since in WEEKDAY_HOLIDAYS:
        rules.append((_nth_weekday(day, month, weekday, nth) & (F.year(day) >= since), name))
    # A real holiday wins over an observed one on the same date.
    rules.sort(key=lambda r: r[1].endswith("(observed)"))
    out = F
    for cond, name in rules:
        out = out.when(cond, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def _fixed_date(day: Column) -> Column:
    """The date itself is a fixed-date holiday."""
    code = F.month(day) * 100 + F.dayofmonth(day)
    by_start: dict[int, list[int]] = {}
    for _, month, dom, since in FIXED_DATE_HOLIDAYS:
        by_start.setdefault(since, []).append(month * 100 + dom)
    out = F.lit(False)
    for since, codes in by_start.items():
        out = out | (code.isin(*codes) & (F.year(day) >= since))
    return out


def holiday_flag(day: Column) -> Column:
    """1 on a federal holiday or its observed day, else 0; shorter than naming it."""
    weekday = F.weekday(day)
    # Only a Friday or a Monday can be the observed day of a neighbour.
    neighbour = F.when(weekday == 4, F.date_add(day, 1)).when(weekday == 0, F.date_sub(day, 1))
    hit = _fixed_date(day) | F.coalesce(_fixed_date(neighbour), F.lit(False))
    for _, month, wd, nth, since in WEEKDAY_HOLIDAYS:
        hit = hit | (_nth_weekday(day, month, wd, nth) & (F.year(day) >= since))
    return F.when(hit, 1).otherwise(0).cast("bigint")
