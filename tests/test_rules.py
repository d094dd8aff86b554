"""Pricing rules, calendar and input contract on hand cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandspark.config import BusinessConfig
from demandspark.functions import calendar as cal
from demandspark.functions import numeric as num
from demandspark.functions import pricing as rules
from demandspark.plans.pricing import add_capacity, price_table, response
from demandspark.sources import contract, io

REQUEST = {
    "datetime": "2011-06-17 08:00:00",
    "season": 2,
    "yr": 0,
    "mnth": 6,
    "hr": 8,
    "holiday": 0,
    "weekday": 5,
    "workingday": 1,
    "weathersit": 2,
    "temp": 0.6,
    "hum": 0.83,
    "windspeed": 0.0,
    "cnt": 454,
}


def one(spark, value, expr, dtype="double"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "t,cls",
    [(-0.01, 4), (0, 3), (9, 3), (9.01, 4), (9.99, 4), (10, 1), (20, 1), (20.5, 4), (21, 2), (29, 2), (29.5, 4), (30, 3), (35, 3), (35.01, 4), (None, None)],
)
def test_temperature_class(spark, t, cls):
    assert one(spark, None if t is None else float(t), rules.temperature_class) == cls


def test_other_classes(spark):
    hum = {0.19: 3, 0.2: 2, 0.39: 2, 0.4: 1, 0.6: 1, 0.61: 2, 0.8: 2, 0.81: 4}
    wind = {-1.0: 1, 0.0: 1, 15.0: 1, 15.5: 1, 16.0: 2, 25.0: 2, 25.5: 1, 26.0: 3, 50.0: 3, 50.01: 4}
    for f, cases in ((rules.humidity_class, hum), (rules.wind_class, wind)):
        df = spark.createDataFrame([(k,) for k in cases], "x double")
        got = {r["x"]: r["y"] for r in df.select("x", f(F.col("x")).alias("y")).collect()}
        assert got == cases


@pytest.mark.parametrize(
    "demand,elasticity,mult,price,surge,discount",
    [
        (0, -1.95, 0.57, 3008.50, 0.0, -542.00),
        (300, -1.54, 0.91, 3230.95, 0.0, -319.55),
        (454, -1.33, 1.16, 4118.58, 568.08, 0.0),
        (800, -0.85, 2.18, 5999.99, 2449.49, 0.0),
    ],
)
def test_worked_request(spark, demand, elasticity, mult, price, surge, discount):
    df = spark.createDataFrame([{**REQUEST, "demand": float(demand)}])
    row = price_table(df).first()
    assert row["competitor_price"] == 4682.56
    assert (row["price_multiplier"], row["price"]) == (mult, price)
    assert (row["surge"], row["discount"]) == (surge, discount)
    assert row["error"] is None and row["currency"] == "NGN"
    util = demand / 800
    got = df.select(rules.dynamic_elasticity(-1.1, F.lit(util), F.lit(1.29)).alias("e")).first()["e"]
    assert got == elasticity


@pytest.mark.parametrize(
    "change,base,error",
    [
        ({"demand": 801.0}, None, "demand_above_capacity"),
        ({"hr": 24}, None, "hour"),
        ({}, 0.0, "base_price_zero"),
        ({}, -1.0, "base_price_negative"),
        ({"competitor_price": -1.0}, None, "competitor_price"),
        ({"weathersit": 5}, None, "weather_class"),
        ({"weathersit": 0}, None, "weather_class"),
    ],
)
def test_broken_contracts(spark, change, base, error):
    df = spark.createDataFrame([{**REQUEST, "demand": 100.0, **change}])
    row = price_table(df, base_price=base).first()
    assert error in row["error"].split(",")
    assert row["price"] is None
    with pytest.raises(Exception, match=error):
        price_table(df, base_price=base, on_error="fail").collect()


def test_price_invariants(spark):
    df = spark.range(0, 900, 7).select(
        F.col("id").cast("double").alias("demand"),
        *[F.lit(v).alias(k) for k, v in REQUEST.items() if k not in ("datetime", "hr")],
        (F.col("id") % 24).alias("hr"),
    )
    cfg = BusinessConfig()
    rows = price_table(df).collect()
    for r in rows:
        if r["demand"] > cfg.max_capacity:
            assert r["price"] is None
        else:
            assert cfg.min_price <= r["price"] <= cfg.max_price
            assert r["surge"] * r["discount"] == 0
    body = response(add_capacity(price_table(df)), as_json=True).first()["response"]
    assert '"status":"success"' in body


def test_null_inputs_use_competitor_defaults(spark):
    schema = "mnth bigint, holiday bigint, hr bigint, weekday bigint, workingday bigint, weathersit bigint, temp double, hum double, windspeed double, cnt bigint"
    row = spark.createDataFrame([(None,) * 10], schema).select(
        *[c.alias(n) for n, c in rules.competitor_norms().items()], rules.competitor_score().alias("s")
    ).first()
    assert row["mnth"] == pytest.approx(5 / 11) and row["cnt"] == 0.2 and row["weekday"] == 0.5
    assert row["hr"] is None and row["temp"] is None and row["s"] is None


def test_numeric_helpers(spark):
    r2 = lambda v: one(spark, v, num.round2)
    assert (r2(2.675), r2(0.125), r2(-1.005), r2(None)) == (2.67, 0.12, -1.0, None)
    for v in (3550.5 * 0.91, 0.375, 2.5, 1234.565, 0.285, -7.445, 99999.995, 1e-9):
        assert r2(v) == round(v, 2)
    assert r2(1e300) == 1e300 and r2(float("inf")) == float("inf")
    assert one(spark, None, lambda x: num.clip(x, 0.0, 1.0)) is None
    assert one(spark, 5.0, lambda x: num.clip(x, 0.0, 1.0)) == 1.0
    labels = {0.71: "positive_very_strong", 0.7: "positive_strong", 0.31: "positive_moderate", 0.3: "positive_weak", 0.0: "negative_weak", -0.8: "negative_very_strong"}
    for v, want in labels.items():
        assert one(spark, v, num.strength_label) == want


def test_calendar(spark):
    days = {
        dt.date(2010, 12, 31): "New Year's Day (observed)",
        dt.date(2011, 1, 17): "Martin Luther King Jr. Day",
        dt.date(2011, 5, 30): "Memorial Day",
        dt.date(2011, 12, 26): "Christmas Day (observed)",
        dt.date(2020, 6, 19): None,
        dt.date(2021, 6, 18): "Juneteenth National Independence Day (observed)",
        dt.date(2023, 11, 23): "Thanksgiving Day",
        dt.date(2023, 11, 16): None,
        dt.date(2024, 2, 19): "Washington's Birthday",
    }
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: r["n"] for r in df.select("d", cal.holiday_name(F.col("d")).alias("n")).collect()}
    assert got == days


def test_contract_bounds(spark):
    base = {k: v for k, v in REQUEST.items() if k not in ("datetime", "yr")}
    rows, want = [], []
    for c, (lo, hi) in contract.BOUNDS.items():
        for value, ok in ((lo, True), (lo - 1, False), *(() if hi is None else ((hi, True), (hi + 1, False)))):
            v = float(value) if c in contract.ROUNDED else int(value)
            rows.append({**base, c: v, "currency": "NGN", "i": len(rows)})
            want.append([] if ok else [c])
    rows.append({**base, "currency": "EUR", "i": len(rows)})
    want.append(["currency"])
    df = spark.createDataFrame(rows)
    got = [r["violations"] for r in contract.check(df).orderBy("i").collect()]
    assert got == want
    ok, bad = contract.split_valid(df)
    assert ok.count() + bad.count() == len(rows) and bad.count() == sum(bool(w) for w in want)


def test_request_and_typed_load(spark, tmp_path):
    req = io.from_records(spark, [{"data": [REQUEST, REQUEST], "currency": None}], io.REQUEST_SCHEMA)
    rows = io.request_rows(req)
    assert rows.count() == 2 and rows.first()["currency"] == "NGN"
    typed = io.typed(rows)
    assert typed.schema["datetime"].dataType.simpleString() == "timestamp"
    bad = spark.createDataFrame([("x", "2011-01-01 00:00:00"), ("3", "no")], "cnt string, datetime string")
    clean, rejected = io.split_rejected(io.typed(bad))
    assert clean.count() == 0 and {tuple(r["bad_columns"]) for r in rejected.collect()} == {("cnt",), ("datetime",)}


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2.0)
    for name, want in (("a.parquet", "a.parquet"), ("b.csv", "b.csv"), ("c.feather", "c.parquet"), ("d", "d.parquet")):
        path = io.write_table(df, f"{tmp_path}/{name}")
        assert path == f"{tmp_path}/{want}"
        back = io.read_csv(spark, path, df.schema) if path.endswith("csv") else io.read_parquet(spark, path)
        assert sorted(back.collect()) == sorted(df.collect())
