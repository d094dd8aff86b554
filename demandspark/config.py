"""Configuration dataclasses.

All defaults are fixed business values: they must stay as they are for results to
match the published behaviour.
"""

from __future__ import annotations

import json
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class LagFeature:
    feature: str
    lags: tuple[int, ...]


@dataclass(frozen=True)
class DiffFeature:
    feature: str
    diffs: tuple[int, ...]


@dataclass(frozen=True)
class RollingFeature:
    feature: str
    windows: tuple[int, ...]


@dataclass(frozen=True)
class InteractionFeature:
    feature_1: str
    feature_2: str
    operation: str  # "add" | "multiply"


@dataclass(frozen=True)
class FeatureConfig:
    """Which ordered-series features to build (names are generated from this)."""

    lag_features: tuple[LagFeature, ...] = (
        LagFeature("cnt", (0, 1, 24)),
        LagFeature("hr", (1, 24)),
        LagFeature("temp", (1, 3)),
    )
    diff_features: tuple[DiffFeature, ...] = (
        DiffFeature("cnt", (1, 2)),
        DiffFeature("hr", (1, 24)),
        DiffFeature("temp", (1, 2, 24)),
    )
    interaction_features: tuple[InteractionFeature, ...] = (
        InteractionFeature("temp", "hum", "add"),
        InteractionFeature("hum", "hr", "add"),
    )
    rolling_features: tuple[RollingFeature, ...] = (
        RollingFeature("cnt", (3, 6)),
        RollingFeature("hr", (3, 6)),
    )
    drop_features: tuple[str, ...] = (
        "atemp",
        "windspeed",
        "casual",
        "registered",
        "datetime",
        "cnt",
        "yr",
    )
    target_col: str = "cnt"


@dataclass(frozen=True)
class BusinessConfig:
    """Price limits, capacity and competitor range."""

    min_price: float = 3008.50
    max_price: float = 5999.99
    base_price: float = 3550.50
    base_elasticity: float = -1.1
    max_capacity: int = 800
    currency: str = "NGN"
    min_competitor_price: float = 3099.99
    max_competitor_price: float = 6250.50


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 100
    max_depth: int = 10
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str | None = None
    bootstrap: bool = True


@dataclass(frozen=True)
class BoostConfig:
    """Boosted trees with an early stop of ``patience`` rounds on validation rows."""

    learning_rate: float = 0.1
    num_boost_round: int = 200
    early_stopping_rounds: int = 20
    max_depth: int = 6
    subsample: float = 1.0
    min_child_weight: int = 1
    min_gain: float = 0.0


BOOST_A = BoostConfig(learning_rate=0.1)
BOOST_B = BoostConfig(learning_rate=0.05)


@dataclass(frozen=True)
class TrainConfig:
    random_seed: int = 42
    test_size: float = 0.1
    val_size: float = 0.1
    cv_test_size: int = 168
    n_splits: int = 3
    target_col: str = "target"
    forest: ForestConfig = field(default_factory=ForestConfig)
    boost_a: BoostConfig = BOOST_A
    boost_b: BoostConfig = BOOST_B


@dataclass(frozen=True)
class SearchSpace:
    """Ranges of a hyper-parameter search.

    ``ints`` and ``floats`` hold (low, high), ``log_floats`` is sampled log-uniform,
    ``choices`` lists categorical values.
    """

    n_trials: int
    ints: dict[str, tuple[int, int]] = field(default_factory=dict)
    floats: dict[str, tuple[float, float]] = field(default_factory=dict)
    log_floats: dict[str, tuple[float, float]] = field(default_factory=dict)
    choices: dict[str, tuple] = field(default_factory=dict)

    def with_trials(self, n: int) -> SearchSpace:
        return replace(self, n_trials=n)


FOREST_SPACE = SearchSpace(
    n_trials=15,
    ints={
        "n_estimators": (50, 300),
        "max_depth": (3, 20),
        "min_samples_split": (2, 10),
        "min_samples_leaf": (1, 5),
    },
    choices={"max_features": (None, "sqrt", "log2"), "bootstrap": (True, False)},
)

# Spark's boosted trees have no L1/L2 or growth-policy setting; the ranges that have a
# counterpart are kept (see README, "Differences").
BOOST_A_SPACE = SearchSpace(
    n_trials=50,
    ints={
        "max_depth": (3, 10),
        "min_child_weight": (1, 10),
        "num_boost_round": (100, 1500),
        "early_stopping_rounds": (20, 50),
    },
    floats={"subsample": (0.6, 1.0)},
    log_floats={"learning_rate": (0.001, 0.3), "min_gain": (1e-6, 1.0)},
)
BOOST_B_SPACE = SearchSpace(
    n_trials=50,
    ints={
        "max_depth": (4, 12),
        "min_child_weight": (10, 50),
        "num_boost_round": (100, 1500),
        "early_stopping_rounds": (20, 50),
    },
    log_floats={"learning_rate": (0.001, 0.3)},
)


# -- settings from mappings and files ---------------------------------------------------------


def from_mapping(kind: type, data: Mapping, where: str = "") -> object:
    """A configuration of ``kind`` from plain values; what is left out keeps its default.

    Unknown names, missing values and values of a wrong type are errors that name the place.
    """
    if not isinstance(data, Mapping):
        raise ValueError(f"{where or kind.__name__}: expected a mapping, got {type(data).__name__}")
    hints = typing.get_type_hints(kind)
    names = {f.name for f in fields(kind)}
    if odd := sorted(set(data) - names):
        raise ValueError(f"{where or kind.__name__}: unknown settings {odd}")
    values = {k: _value(hints[k], v, f"{where}.{k}" if where else k) for k, v in data.items()}
    try:
        return kind(**values)
    except TypeError as e:
        raise ValueError(f"{where or kind.__name__}: {e}") from None


def _value(kind: object, value: object, where: str) -> object:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if is_dataclass(kind):
        return from_mapping(kind, value, where)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        return _value(next(a for a in args if a is not type(None)), value, where)
    if origin is tuple:
        if isinstance(value, str) or not isinstance(value, (list, tuple)):
            raise ValueError(f"{where}: expected a list")
        each = [args[0]] * len(value) if len(args) == 2 and args[1] is Ellipsis else list(args)
        if len(each) != len(value):
            raise ValueError(f"{where}: expected {len(each)} values")
        return tuple(_value(k, v, f"{where}[{i}]") for i, (k, v) in enumerate(zip(each, value)))
    if origin is dict:
        if not isinstance(value, Mapping):
            raise ValueError(f"{where}: expected a mapping")
        return {k: _value(args[1], v, f"{where}.{k}") for k, v in value.items()}
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind is tuple:
        return tuple(value)
    if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
        raise ValueError(f"{where}: expected {kind.__name__}, got {value!r}")
    return value


def from_json(kind: type, text: str) -> object:
    """Like :func:`from_mapping`, from the text of a JSON file."""
    return from_mapping(kind, json.loads(text))
