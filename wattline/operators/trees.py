"""Pooled gradient-boosted trees with absolute loss, grown leaf by leaf, walked forward.

One model over all hours: the panel's features and the local hour. Every refit learns from
all days before it. Refits are dealt to blocks of consecutive dates; a block's task holds
the rows up to its last date (bounded by the calendar) and refits in order, so blocks run
in parallel and no fit ever sees a later day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 255


@dataclass(frozen=True)
class TreeSettings:
    """How trees grow; checked on creation."""

    rounds: int = 100
    leaves: int = 15
    rate: float = 0.05
    least_rows: int = 48
    ridge: float = 1.0

    def __post_init__(self) -> None:
        if self.rounds < 1 or self.leaves < 2 or self.least_rows < 1:
            raise ValueError("rounds and rows per leaf must be positive, leaves at least two")
        if not self.rate > 0 or self.ridge < 0:
            raise ValueError("the learning rate must be positive and the penalty not negative")


#: The settings that are tried.
GRID = (TreeSettings(leaves=15, rate=0.05, least_rows=48, ridge=1.0), TreeSettings(leaves=31, rate=0.03, least_rows=48, ridge=2.0), TreeSettings(leaves=63, rate=0.02, least_rows=64, ridge=4.0))


def bin_edges(column: np.ndarray) -> np.ndarray:
    """Upper edges of at most BINS bins; midpoints between neighbouring distinct values."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
    return (values[1:] + values[:-1]) / 2


class Boosted:
    """A fitted ensemble."""

    def __init__(self, start: float, trees: list[list[tuple]], rate: float):
        self.start, self.trees, self.rate = start, trees, rate

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for nodes in self.trees:
            place = np.zeros(len(x), int)
            for i, (feature, edge, left, right, _) in enumerate(nodes):  # children follow their parents
                if feature >= 0:
                    here = np.flatnonzero(place == i)
                    place[here] = np.where(x[here, feature] <= edge, left, right)
            out += self.rate * np.array([node[4] for node in nodes])[place]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, settings: TreeSettings) -> Boosted:
    """Absolute loss: trees follow the signs of the residuals, leaves take their median."""
    edges = [bin_edges(x[:, j]) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    width = max(len(e) for e in edges) + 1
    offset = np.arange(x.shape[1]) * width
    start = float(np.median(y))
    fitted, trees = np.full(len(y), start), []

    def best_split(rows: np.ndarray, slope: np.ndarray):
        """(gain, feature, bin) of a node's best split; the first feature and edge win ties."""
        flat = (binned[rows] + offset).ravel()
        n = np.bincount(flat, minlength=len(offset) * width).reshape(len(offset), width).cumsum(axis=1)
        g = np.bincount(flat, np.repeat(slope[rows], len(offset)), minlength=len(offset) * width).reshape(len(offset), width).cumsum(axis=1)
        total, size = g[0, -1], len(rows)
        fits = (n >= settings.least_rows) & (size - n >= settings.least_rows)
        gain = g**2 / (n + settings.ridge + 1e-12) + (total - g) ** 2 / (size - n + settings.ridge + 1e-12) - total**2 / (size + settings.ridge + 1e-12)
        gain = np.where(fits, np.round(gain, 9), -np.inf)
        at = int(np.argmax(gain))
        return gain.flat[at], at // width, at % width

    for _ in range(settings.rounds):
        slope = np.sign(y - fitted)
        nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
        members = {0: np.arange(len(y))}
        open_ = {0: best_split(members[0], slope)}
        while len(members) < settings.leaves and open_:
            node = max(open_, key=lambda k: (open_[k][0], -k))
            gain, feature, place = open_.pop(node)
            if not gain > 1e-9:
                break
            rows = members.pop(node)
            low = binned[rows, feature] <= place
            nodes[node][:4] = [feature, float(edges[feature][place]), len(nodes), len(nodes) + 1]
            for part in (rows[low], rows[~low]):
                members[len(nodes)] = part
                open_[len(nodes)] = best_split(part, slope)
                nodes.append([-1, 0.0, -1, -1, 0.0])
        for node, rows in members.items():
            nodes[node][4] = float(np.median(y[rows] - fitted[rows]))
            fitted[rows] += settings.rate * nodes[node][4]
        trees.append([tuple(n) for n in nodes])
    return Boosted(start, trees, settings.rate)


def boosted_forecasts(
    panel: DataFrame, features: Sequence[str], start: dt.date, end: dt.date | None = None, target: str = "price", settings: TreeSettings = GRID[0], min_train_days: int = 30,
    window: int | None = None, refit_every_days: int = 1, blocks: int = 32,
) -> DataFrame:
    """Forecasts of the complete cells from ``start`` on, refitted every so many scored days.

    A fit learns from the complete rows of earlier days (of the last ``window`` ones); days
    before ``min_train_days`` such days are left out.
    """
    if refit_every_days < 1 or blocks < 1:
        raise ValueError("refit_every_days and blocks must be positive")
    if window is not None and window < min_train_days:
        raise ValueError(f"a rolling window must hold at least {min_train_days} days")
    names, inputs = list(features), [*features, "local_hour"]
    rows = panel.select("local_date", "local_hour", target, *names).dropna()
    scored = rows.where(F.col("local_date") >= F.lit(start))
    if end is not None:
        scored = scored.where(F.col("local_date") <= F.lit(end))
    days = [r[0] for r in scored.select("local_date").distinct().orderBy("local_date").collect()]  # one row per day
    spark: SparkSession = panel.sparkSession
    schema = "local_date date, local_hour int, forecast double"
    if not days:
        return spark.createDataFrame([], schema)
    refits = [days[i : i + refit_every_days] for i in range(0, len(days), refit_every_days)]
    size = -(-len(refits) // blocks)
    dealt = [refits[i : i + size] for i in range(0, len(refits), size)]
    plan = spark.createDataFrame([(i, part[-1][-1]) for i, part in enumerate(dealt)], "block int, until date")
    copies = rows.join(F.broadcast(plan), F.col("local_date") <= F.col("until"))  # at most ``blocks`` rows

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["local_date", "local_hour"])
        date = pd.to_datetime(part["local_date"]).to_numpy()
        x, y = part[inputs].to_numpy(float), part[target].to_numpy(float)
        found = []
        for group in dealt[int(part["block"].iloc[0])]:
            first, last = np.datetime64(group[0]), np.datetime64(group[-1])
            past = np.unique(date[date < first])
            if len(past) < min_train_days:
                continue
            known = (date < first) & (date >= past[-window] if window else True)
            asked = (date >= first) & (date <= last)
            forecast = fit_boosted(x[known], y[known], settings).predict(x[asked])
            found.append(pd.DataFrame({"local_date": part["local_date"].to_numpy()[asked], "local_hour": part["local_hour"].to_numpy(int)[asked], "forecast": forecast}))
        return pd.concat(found) if found else pd.DataFrame({"local_date": [], "local_hour": [], "forecast": []})

    return copies.groupBy("block").applyInPandas(walk, schema)


def boosted_day(panel: DataFrame, features: Sequence[str], day: dt.date, target: str = "price", settings: TreeSettings = GRID[0], min_train_days: int = 30) -> DataFrame:
    """Forecasts of one day, whose own target is never read."""
    blank = panel.where(F.col("local_date") < F.lit(day)).unionByName(panel.where(F.col("local_date") == F.lit(day)).withColumn(target, F.lit(0.0)))
    return boosted_forecasts(blank, features, day, day, target, settings, min_train_days, blocks=1)


def select_settings(panel: DataFrame, features: Sequence[str], start: dt.date, end: dt.date, target: str = "price", grid: Sequence[TreeSettings] = GRID, min_train_days: int = 30, refit_every_days: int = 1) -> tuple[TreeSettings, DataFrame]:
    """The grid's setting with the smallest validation error, and (place, n, mae) of all."""
    if not grid:
        raise ValueError("the grid of tree settings must not be empty")
    actual = panel.select("local_date", "local_hour", F.col(target).alias("actual"))
    parts = []
    for i, settings in enumerate(grid):
        found = boosted_forecasts(panel, features, start, end, target, settings, min_train_days, refit_every_days=refit_every_days)
        errors = found.join(actual, ["local_date", "local_hour"]).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"))
        parts.append(errors.where("n > 0").select(F.lit(i).alias("place"), "n", "mae"))
    search = parts[0]
    for part in parts[1:]:
        search = search.unionByName(part)
    rows = sorted(search.collect(), key=lambda r: (r["mae"], r["place"]))  # one row per setting
    if not rows:
        raise ValueError("no tree setting gave a validation forecast")
    return replace(grid[rows[0]["place"]]), panel.sparkSession.createDataFrame([tuple(r) for r in rows], "place int, n long, mae double")
