"""Frozen model configurations by name; a changed configuration is a new model version."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.models import NAIVE, ridge_predict_day
from wattline.operators.trees import boosted_day
from wattline.sources.evidence import digest

from .panel import BASE_FEATURES, FUNDAMENTAL_FEATURES, Panel


@dataclass(frozen=True)
class ModelConfig:
    name: str
    kind: str
    features: tuple[str, ...]
    alpha: float | None = None
    fundamentals: bool = False

    @property
    def version(self) -> str:
        return digest(asdict(self))[:12]


MODELS: dict[str, ModelConfig] = {
    **{name: ModelConfig(name, "naive", (column,)) for name, column in NAIVE.items()},
    "ridge": ModelConfig("ridge", "ridge", BASE_FEATURES, 0.1),
    "ridge_da": ModelConfig("ridge_da", "ridge", BASE_FEATURES + FUNDAMENTAL_FEATURES, 0.1, True),
    "boosted_trees": ModelConfig("boosted_trees", "trees", BASE_FEATURES),
}


def get_model(name: str) -> ModelConfig:
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name]


def policy_id(name: str) -> str:
    """Name and version: what an issue records as its model."""
    return f"{name}-{get_model(name).version}"


def restored(facts: Mapping[str, object]) -> ModelConfig:
    """A configuration as evidence holds it."""
    kind = facts["kind"]
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model {kind!r}")
    return ModelConfig(**{**facts, "features": tuple(facts["features"])})


def forecast_day(model: ModelConfig, panel: Panel, day: dt.date, min_train_rows: int) -> DataFrame:
    """(local_date, local_hour, forecast) of one day from what lies before it."""
    return KINDS[model.kind](model, panel, day, min_train_rows).select("local_date", "local_hour", "forecast")


def _naive(model: ModelConfig, panel: Panel, day: dt.date, least: int) -> DataFrame:
    return panel.frame.where(F.col("local_date") == F.lit(day)).select("local_date", "local_hour", F.col(model.features[0]).alias("forecast")).where("forecast is not null")


def _ridge(model: ModelConfig, panel: Panel, day: dt.date, least: int) -> DataFrame:
    return ridge_predict_day(panel.frame, model.features, day, panel.target, model.alpha, least)


def _trees(model: ModelConfig, panel: Panel, day: dt.date, least: int) -> DataFrame:
    return boosted_day(panel.frame, model.features, day, panel.target, min_train_days=least)


KINDS = {"naive": _naive, "ridge": _ridge, "trees": _trees}
