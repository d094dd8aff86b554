from __future__ import annotations

import json
from dataclasses import asdict

import pytest

from demandspark import config as c


@pytest.mark.parametrize("kind", [c.FeatureConfig, c.BusinessConfig, c.TrainConfig])
def test_defaults_survive_a_round_trip(kind):
    assert c.from_json(kind, json.dumps(asdict(kind()))) == kind() == c.from_mapping(kind, {})


def test_search_spaces_survive_a_round_trip():
    assert c.from_mapping(c.SearchSpace, json.loads(json.dumps(asdict(c.FOREST_SPACE)))) == c.FOREST_SPACE


def test_settings_are_checked():
    got = c.from_mapping(c.FeatureConfig, {"lag_features": [{"feature": "cnt", "lags": [1, 2]}], "target_col": "y"})
    assert got.lag_features == (c.LagFeature("cnt", (1, 2)),) and got.drop_features == c.FeatureConfig().drop_features
    assert c.from_mapping(c.BusinessConfig, {"min_price": 3000}).min_price == 3000.0
    for kind, data, place in (
        (c.BusinessConfig, {"min_prise": 1.0}, "min_prise"), (c.BusinessConfig, {"max_capacity": 1.5}, "max_capacity"),
        (c.FeatureConfig, {"lag_features": [{"feature": "cnt", "lags": "12"}]}, r"lag_features\[0\].lags"),
        (c.FeatureConfig, {"lag_features": [{"lags": [1]}]}, "feature"), (c.TrainConfig, {"forest": 3}, "forest"),
        (c.TrainConfig, {"random_seed": True}, "random_seed"),
    ):
        with pytest.raises(ValueError, match=place):
            c.from_mapping(kind, data)
