"""Walk-forward price models: naive projections and per-hour ridge (trees: ``trees.py``).

Ridge refits every day at every local hour. All refits of one hour come from running
sums of the moments and one batched solve, inside a grouped map per zone and hour.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAIVE = {"naive_previous_day": "price_d1", "naive_previous_week": "price_d7", "naive_similar_day": "price_similar_day"}
ALPHAS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
#: Fixed value: a deviation below this share of a feature's level counts as none.
CONSTANT = 1e-9


def naive_forecasts(panel: DataFrame) -> DataFrame:
    """(model, local_date, local_hour, forecast): lagged columns, nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("forecast")) for m, c in NAIVE.items()])).alias("x")
    return panel.select("local_date", "local_hour", pairs).select("x.model", "local_date", "local_hour", "x.forecast").where("forecast is not null")


@dataclass(frozen=True)
class Moments:
    """Running sums over the rows of one cell, taken about a fixed point near the data.

    Shifting rows does not change a ridge with a free intercept, and keeps small deviations
    from drowning in large means. ``spans(start, stop)`` are the sums of rows start..stop-1.
    """

    shift: np.ndarray  # per feature
    count: np.ndarray
    first: np.ndarray  # (rows + 1, features)
    second: np.ndarray  # (rows + 1, features, features)
    target: np.ndarray
    cross: np.ndarray
    changes: np.ndarray  # how often a feature differs from the row before

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> Moments:
        shift = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        z = x - shift
        run = lambda values: np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
        steps = np.concatenate([np.zeros((min(1, len(z)), z.shape[1])), (z[1:] != z[:-1]).astype(float)])
        return Moments(shift, np.arange(len(z) + 1.0), run(z), run(z[:, :, None] * z[:, None, :]), run(y), run(z * y[:, None]), run(steps))

    def weights(self, start: np.ndarray, stop: np.ndarray, alpha: float) -> np.ndarray:
        """[intercept, weights] for each pair of row bounds (start < stop)."""
        part = lambda sums: sums[stop] - sums[start]
        n = part(self.count)
        mean, mean_y = part(self.first) / n[:, None], part(self.target) / n
        spread = part(self.second) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        to_y = part(self.cross) / n[:, None] - mean * mean_y[:, None]
        deviation = np.sqrt(np.maximum(np.einsum("...ii->...i", spread), 0.0))
        # Steps into a span's first row do not count.
        moved = (self.changes[stop] - self.changes[np.minimum(start + 1, stop)]) > 0
        varies = moved & (deviation > CONSTANT * (1.0 + np.abs(mean + self.shift)))
        unit = np.where(varies, deviation, 1.0)
        both = varies[:, :, None] & varies[:, None, :]
        system = np.where(both, spread / (unit[:, :, None] * unit[:, None, :]), 0.0)
        system = system + np.eye(len(self.shift)) * np.where(varies, alpha, 1.0)[:, None, :]
        found = np.linalg.solve(system, np.where(varies, to_y / unit, 0.0)[..., None])[..., 0] / unit
        found = np.where(varies, found, 0.0)
        return np.column_stack([mean_y - ((mean + self.shift) * found).sum(axis=1), found])


def ridge_weights(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, weights] of one fit: population-standardised features, penalty alpha per row.

    The intercept is free; a feature whose deviation is below ``CONSTANT`` of its level has
    weight 0.
    """
    return Moments.of(x, y).weights(np.array([0]), np.array([len(y)]), alpha)[0]


def _cells(panel: DataFrame) -> list[str]:
    """What makes a cell of its own: the local hour, and the zone where the panel names it."""
    return [c for c in ("zone", "local_hour") if c in panel.columns]


def _schema(keys: Sequence[str], rest: str) -> str:
    kinds = {"zone": "zone string", "local_hour": "local_hour int", "alpha": "alpha double"}
    return ", ".join([*(kinds[k] for k in keys), rest])


def _labels(part: pd.DataFrame, keys: Sequence[str], n: int) -> dict[str, object]:
    kinds = {"local_hour": "int32", "zone": object, "alpha": float}
    return {k: np.full(n, part[k].iloc[0], dtype=kinds[k]) for k in keys}


def _floor(least: int, features: Sequence[str], window: int | None = None) -> int:
    """Rows that a fit needs; a rolling window must be able to hold them."""
    if least < 0:
        raise ValueError("min_train_rows cannot be negative")
    floor = max(least, len(features) + 2)
    if window is not None and window < floor:
        raise ValueError(f"a rolling window must hold at least {floor} rows")
    return floor


def _walk(part: pd.DataFrame, features: list[str], target: str, alpha: float, floor: int, start, end, window: int | None) -> tuple[pd.DataFrame, np.ndarray]:
    """Scored rows of one cell with their forecasts, each from the complete rows before it."""
    rows = part.dropna(subset=[*features, target]).sort_values("local_date").reset_index(drop=True)
    x, y = rows[features].to_numpy(float).reshape(len(rows), len(features)), rows[target].to_numpy(float)
    dates = pd.to_datetime(rows["local_date"])
    scored = np.arange(len(rows)) >= floor
    if start is not None:
        scored &= (dates >= pd.Timestamp(start)).to_numpy()
    if end is not None:
        scored &= (dates <= pd.Timestamp(end)).to_numpy()
    at = np.flatnonzero(scored)
    if not len(at) or not features:
        return rows.iloc[:0], np.zeros(0)
    low = np.maximum(0, at - window) if window else np.zeros(len(at), int)
    found = Moments.of(x, y).weights(low, at, alpha)
    return rows.iloc[at], found[:, 0] + (found[:, 1:] * x[at]).sum(axis=1)


def ridge_walk_forward(panel: DataFrame, features: Sequence[str], target: str = "price", alpha: float = 0.1, min_train_rows: int = 30, start: dt.date | None = None, end: dt.date | None = None, window: int | None = None) -> DataFrame:
    """Forecast of each complete cell from a refit on all earlier complete rows of its zone and hour."""
    names, keys, floor = list(features), _cells(panel), _floor(min_train_rows, features, window)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        rows, forecast = _walk(part, names, target, alpha, floor, start, end, window)
        return pd.DataFrame({**_labels(part, keys, len(rows)), "local_date": rows["local_date"].to_numpy(), "forecast": forecast})

    found = panel.select("local_date", *keys, target, *names).groupBy(*keys).applyInPandas(fit, _schema(keys, "local_date date, forecast double"))
    return found.select(*[c for c in ("zone", "local_date", "local_hour", "forecast") if c in found.columns])


def ridge_predict_day(panel: DataFrame, features: Sequence[str], day: dt.date, target: str = "price", alpha: float = 0.1, min_train_rows: int = 30, window: int | None = None) -> DataFrame:
    """Forecasts of one day from fits on what lies strictly before it; its own target is never read.

    Hours with a missing feature or too little history are left out.
    """
    names, keys, floor = list(features), _cells(panel), _floor(min_train_rows, features, window)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        dates = pd.to_datetime(part["local_date"])
        past = part[dates < pd.Timestamp(day)].dropna(subset=[*names, target]).sort_values("local_date")
        wanted = part[dates == pd.Timestamp(day)].dropna(subset=names)
        if len(past) < floor or wanted.empty or not names:
            wanted, forecast = wanted.iloc[:0], np.zeros(0)
        else:
            past = past.tail(window) if window else past
            found = ridge_weights(past[names].to_numpy(float), past[target].to_numpy(float), alpha)
            forecast = found[0] + wanted[names].to_numpy(float) @ found[1:]
        return pd.DataFrame({**_labels(part, keys, len(wanted)), "local_date": wanted["local_date"].to_numpy(), "forecast": forecast})

    rows = panel.where(F.col("local_date") <= F.lit(day)).select("local_date", *keys, target, *names)
    found = rows.groupBy(*keys).applyInPandas(fit, _schema(keys, "local_date date, forecast double"))
    return found.select(*[c for c in ("zone", "local_date", "local_hour", "forecast") if c in found.columns])


def ridge_coefficients(panel: DataFrame, features: Sequence[str], target: str = "price", alpha: float = 0.1, before: dt.date | None = None, window: int | None = None) -> DataFrame:
    """(local_hour, feature, coefficient, train_sd, effect) at the last refit of each cell.

    ``before``: only rows of earlier days are learned from. Cells with no more rows than
    features are left out.
    """
    names, keys = list(features), _cells(panel)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.dropna(subset=[*names, target]).sort_values("local_date")
        rows = rows.tail(window) if window else rows
        n = len(names) if len(rows) > len(names) else 0
        x, y = rows[names].to_numpy(float), rows[target].to_numpy(float)
        weights = ridge_weights(x, y, alpha)[1:] if n else np.zeros(0)
        deviation = x.std(axis=0) if n else np.zeros(0)
        return pd.DataFrame({**_labels(part, keys, n), "feature": np.array(names[:n], dtype=object), "coefficient": weights, "train_sd": deviation, "effect": weights * deviation})

    rows = panel if before is None else panel.where(F.col("local_date") < F.lit(before))
    return rows.select("local_date", *keys, target, *names).groupBy(*keys).applyInPandas(fit, _schema(keys, "feature string, coefficient double, train_sd double, effect double"))


def alpha_search(panel: DataFrame, features: Sequence[str], start: dt.date, end: dt.date, alphas: Sequence[float] = ALPHAS, target: str = "price", min_train_rows: int = 30) -> DataFrame:
    """(alpha, n, mae) over a validation window, every alpha and cell in parallel."""
    names, keys, floor = list(features), ["alpha", *_cells(panel)], _floor(min_train_rows, features)
    grid = panel.select("local_date", *keys[1:], target, *names).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        alpha = float(part["alpha"].iloc[0])
        rows, forecast = _walk(part, names, target, alpha, floor, start, end, None)
        errors = np.abs(rows[target].to_numpy(float) - forecast)
        return pd.DataFrame({"alpha": [alpha], "n": [len(rows)], "total": [float(errors.sum())]})

    parts = grid.groupBy(*keys).applyInPandas(fit, "alpha double, n long, total double")
    return parts.groupBy("alpha").agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mae")).where("n > 0")
