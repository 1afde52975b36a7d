"""Column helpers that hold under ANSI mode and for missing data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is null, never an error, for a zero divisor."""
    return F.try_divide(top, bottom)


def weighted_mean(value: Column, weight: Column, mask: Column | None = None) -> Column:
    """sum(value * weight) / sum(weight) over the rows of ``mask``; null without any."""
    if mask is not None:
        value, weight = F.when(mask, value), F.when(mask, weight)
    return ratio(F.sum(value * weight), F.sum(weight))


def is_finite(value: Column) -> Column:
    """False for NaN and infinities, null for null."""
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over pairs, null where one side does not vary."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mean_of(columns: Iterable[str]) -> Column:
    """Mean across columns that skips nulls."""
    names = list(columns)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return ratio(total, present.cast("double"))


def require(frame: DataFrame, bad: Column, message: str) -> None:
    """Raise if any row is ``bad``; one aggregated job, no rows on the driver."""
    if frame.where(bad).limit(1).count():
        raise ValueError(message)


def require_unique(frame: DataFrame, keys: Iterable[str], message: str) -> None:
    require(frame.groupBy(*keys).count(), F.col("count") > 1, message)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded: sums differ in the last bits between partitionings."""
    return frame.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes])
