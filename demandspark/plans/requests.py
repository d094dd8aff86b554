"""Requests for a price: records in, checked, forecast with a stored model, priced, answered."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.config import BusinessConfig, FeatureConfig
from demandspark.functions.pricing import COMPETITOR_INPUTS
from demandspark.operators.ordered import SeriesSpec
from demandspark.plans.features import Thresholds
from demandspark.plans.pricing import add_capacity, price_table
from demandspark.plans.scoring import score_demand
from demandspark.sources import contract, io

_REQUEST = "__request"
_PRICED = ("hr", "temp", "hum", "windspeed", "weathersit")


def save_model(model: PipelineModel, path: str) -> str:
    """A trained pipeline as Spark ML files."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def checked_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, rejected rows with ``violations``).

    ``requests`` holds a ``data`` list and a currency; a time that can't be read is a violation.
    """
    rows = io.typed(io.request_rows(requests), {"datetime": "timestamp"}).drop("bad_columns")
    found = contract.check(rows)
    unread = F.when(F.col("datetime").isNull(), F.array(F.lit("datetime"))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("violations", F.concat("violations", unread))
    ok = F.size("violations") == 0
    return contract.round_inputs(found.where(ok).drop("violations")), found.where(~ok)


def score_requests(
    requests: DataFrame,
    history: DataFrame,
    model: PipelineModel,
    spec: SeriesSpec,
    thresholds: Thresholds,
    features: FeatureConfig | None = None,
    business: BusinessConfig | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(priced requests with capacity columns, rejected requests).

    ``history`` are hours before the requests, which give lags and differences their values;
    ``thresholds`` are those the model was trained with. ``pricing.response`` makes the answer.
    """
    valid, rejected = checked_requests(requests)
    names = [c for c in valid.columns if c != "currency"]
    past = history.select(*names).withColumns({"currency": F.lit(None).cast("string"), _REQUEST: F.lit(False)})
    rows = past.unionByName(valid.withColumn(_REQUEST, F.lit(True)))
    keep = list(dict.fromkeys([*spec.columns, _REQUEST, "currency", *_PRICED, *COMPETITOR_INPUTS]))
    scored = score_demand(model, rows, spec, features, thresholds, keep)
    priced = price_table(scored.where(_REQUEST).drop(_REQUEST), business, currency=F.col("currency"))
    return add_capacity(priced, business), rejected
