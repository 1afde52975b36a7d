"""Walk-forward backtest: split, tune, forecast, common sample, intervals, scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.models import ALPHAS, alpha_search, naive_forecasts, ridge_coefficients, ridge_walk_forward
from wattline.operators.pit import common_sample
from wattline.operators.risk import BASELINES
from wattline.operators.scoring import daily_errors, scoreboard, with_quantiles
from wattline.operators.trees import GRID, TreeSettings, boosted_forecasts, select_settings
from wattline.sources.evidence import fingerprint

from .panel import Panel

REFERENCE = "naive_similar_day"


class InsufficientHistory(ValueError):
    """Fewer usable days than training and validation need."""


@dataclass(frozen=True)
class BacktestResult:
    predictions: DataFrame
    scores: DataFrame
    daily: DataFrame
    coefficients: DataFrame
    search: DataFrame
    alpha: float
    validation: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]
    protocol: Mapping[str, object]

    @property
    def test_start(self) -> dt.date:
        return self.test[0]

    @property
    def test_end(self) -> dt.date:
        return self.test[1]

    def metadata(self) -> dict[str, object]:
        """What was run, on which days, and the headline scores, as JSON can hold it."""
        overall = self.scores.where("scope = 'overall'").select("model", "n", "mae", "rmse", "skill_pct", "skill_vs_best_baseline_pct")
        days = self.daily.agg(F.countDistinct("local_date").alias("n")).first()["n"]
        return {
            "reference": REFERENCE,
            "alpha": self.alpha,
            "validation_start": str(self.validation[0]),
            "validation_end": str(self.validation[1]),
            "test_start": str(self.test[0]),
            "test_end": str(self.test[1]),
            "test_days": days,
            "search": [r.asDict() for r in self.search.orderBy("alpha").collect()],  # one row per alpha
            "overall": [r.asDict() for r in overall.orderBy("model").collect()],  # one row per model
            "predictions_sha256": fingerprint(self.predictions),
            **self.protocol,
        }


def split_days(frame: DataFrame, train: int, validation: int) -> tuple[dt.date, dt.date, dt.date, dt.date]:
    """Starts of validation and test, and the last day before each, by usable distinct days."""
    days = [r[0] for r in frame.select("local_date").distinct().orderBy("local_date").collect()]  # one row per day
    if len(days) <= train + validation:
        raise InsufficientHistory(f"{len(days)} usable days; {train + validation + 1} are needed")
    return days[train], days[train + validation - 1], days[train + validation], days[-1]


def run(
    panel: Panel, min_train_days: int = 270, validation_days: int = 90, alphas: Sequence[float] = ALPHAS, min_train_rows: int = 30, trees: bool = False, end: dt.date | None = None, alpha: float | None = None,
    refit_every_days: int = 1, grid: Sequence[TreeSettings] = GRID,
) -> BacktestResult:
    """All models over the same test hours; penalty and tree settings are chosen on validation days only."""
    usable = panel.complete() if end is None else panel.complete().where(F.col("local_date") <= F.lit(end))
    usable = usable.persist()  # read by every model and search
    val_start, val_end, test_start, test_end = split_days(usable, min_train_days, validation_days)
    search = alpha_search(usable, panel.features, val_start, val_end, alphas if alpha is None else (alpha,), panel.target, min_train_rows).persist()
    best = float(search.orderBy("mae", "alpha").first()["alpha"])
    cells = ["local_date", "local_hour", "forecast"]
    ridge = ridge_walk_forward(usable, panel.features, panel.target, best, min_train_rows, test_start, test_end).select(*cells).withColumn("model", F.lit("ridge"))
    naive = naive_forecasts(usable).where(F.col("local_date").between(F.lit(test_start), F.lit(test_end)))
    forecasts, protocol = naive.unionByName(ridge), {"zone": panel.zone.code, "features": list(panel.features), "min_train_days": min_train_days, "validation_days": validation_days, "min_train_rows": min_train_rows}
    if trees:
        settings, _ = select_settings(usable, panel.features, val_start, val_end, panel.target, grid, min_train_rows, refit_every_days)
        boosted = boosted_forecasts(usable, panel.features, test_start, test_end, panel.target, settings, min_train_rows, refit_every_days=refit_every_days)
        forecasts = forecasts.unionByName(boosted.withColumn("model", F.lit("boosted_trees")))
        protocol["trees"] = asdict(settings) | {"refit_every_days": refit_every_days}
    sample = common_sample(forecasts)
    actual = usable.select("local_date", "local_hour", F.col(panel.target).alias("actual"))
    predictions = with_quantiles(sample.join(actual, ["local_date", "local_hour"]))
    scores = scoreboard(predictions, panel.zone, REFERENCE, BASELINES)
    coefficients = ridge_coefficients(usable, panel.features, panel.target, best, before=test_end)
    return BacktestResult(predictions, scores, daily_errors(predictions), coefficients, search, best, (val_start, val_end), (test_start, test_end), protocol)


def fundamentals_ablation(plain: Panel, informed: Panel, **options) -> DataFrame:
    """Overall scores of the fitted models without and with published forecasts as inputs."""
    parts = []
    for panel, included in ((plain, False), (informed, True)):
        result = run(panel, **options)
        overall = result.scores.where((F.col("scope") == "overall") & F.col("model").isin("ridge", "boosted_trees"))
        parts.append(
            overall.select(
                F.lit(panel.zone.code).alias("zone"), "model", F.lit(included).alias("include_fundamentals"), "n", "mae", "rmse", "skill_vs_best_baseline_pct",
                F.lit(str(result.test_start)).alias("test_start"), F.lit(str(result.test_end)).alias("test_end"),
            )
        )
    return parts[0].unionByName(parts[1])
