"""Market-local time over UTC wall clocks (TIMESTAMP_NTZ).

Nothing is keyed on a UTC day: keys are the local date and hour of a zone, whose days
have 23, 24 or 25 hours. Clock cells are always derived from UTC hours, because the
repeated autumn hour cannot be told apart from the local side.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


@dataclass(frozen=True)
class PeakBlock:
    """Half-open local hours on ISO weekdays; public holidays are not excluded."""

    start_hour: int = 8
    end_hour: int = 20
    weekdays: tuple[int, ...] = (1, 2, 3, 4, 5)


@dataclass(frozen=True)
class Zone:
    code: str
    timezone: str
    currency: str
    country: str
    peak: PeakBlock = PeakBlock()
    datasets: tuple[str, ...] = ("price", "load", "generation", "fundamentals")


ZONES: dict[str, Zone] = {"DE-LU": Zone("DE-LU", "Europe/Berlin", "EUR", "de")}
DE_LU = ZONES["DE-LU"]


def get_zone(code: str) -> Zone:
    if code not in ZONES:
        raise KeyError(f"unknown zone {code!r}; known: {sorted(ZONES)}")
    return ZONES[code]


def utc_literal(value: dt.datetime) -> Column:
    """A UTC wall clock as a constant; ``F.lit(datetime)`` would be read in the host's zone.

    Aware datetimes are taken to UTC, naive ones are UTC already.
    """
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def to_local(ts: Column, zone: Zone) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone.timezone), ts)


def to_utc(local: Column, zone: Zone) -> Column:
    """Only for unambiguous wall clocks such as midnight and noon."""
    return F.convert_timezone(F.lit(zone.timezone), F.lit("UTC"), local.cast("timestamp_ntz"))


def attach_local_time(frame: DataFrame, zone: Zone, ts: str = "ts_utc") -> DataFrame:
    """Adds ts_local, local_date and local_hour; ``ts`` must be a UTC wall clock."""
    if dict(frame.dtypes).get(ts) != "timestamp_ntz":
        raise TypeError(f"{ts} must be a UTC wall clock of type timestamp_ntz")
    local = to_local(F.col(ts), zone)
    return frame.withColumns({"ts_local": local, "local_date": F.to_date(local), "local_hour": F.hour(local).cast("int")})


def attach_block(frame: DataFrame, zone: Zone) -> DataFrame:
    """Adds ``block``: on_peak or off_peak, from local_date and local_hour."""
    peak = zone.peak
    inside = (F.col("local_hour") >= peak.start_hour) & (F.col("local_hour") < peak.end_hour)
    inside = inside & (F.weekday("local_date") + 1).isin(*peak.weekdays)
    return frame.withColumn("block", F.when(inside, "on_peak").otherwise("off_peak"))


def period_label(period: str, date: str = "local_date") -> Column:
    if period == "all":
        return F.lit("all")
    if period not in PERIODS:
        raise ValueError(f"period must be one of {[*PERIODS, 'all']}, got {period!r}")
    return F.date_format(date, PERIODS[period])


def interval_hours(minutes: str = "resolution_min") -> Column:
    """Hours of an interval, from its own resolution: never an assumed hour."""
    return F.col(minutes).cast("double") / F.lit(60.0)


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), ts)


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def truncated(ts: Column, minutes: int = 60) -> Column:
    """Start of the bucket of whole minutes (a divisor of 60) that holds ``ts``, without any session zone."""
    return ts - F.make_dt_interval(mins=F.minute(ts) % minutes, secs=F.date_part(F.lit("SECOND"), ts))


def day_start(date: Column, zone: Zone) -> Column:
    """UTC instant of a local midnight."""
    return to_utc(date, zone)


def day_hours(date: Column, zone: Zone) -> Column:
    """True length of a local day: 23, 24 or 25 hours."""
    return F.timestamp_diff("HOUR", day_start(date, zone), day_start(F.date_add(date, 1), zone)).cast("int")


def cell_hours(date: Column, hour: Column, zone: Zone) -> Column:
    """UTC hours that a local clock cell spans: 2 for the repeated autumn hour, 0 for the skipped one."""
    hours = F.sequence(day_start(date, zone), F.timestamp_add("HOUR", F.lit(-1), day_start(F.date_add(date, 1), zone)), F.expr("interval 1 hour"))
    return F.size(F.filter(hours, lambda h: F.hour(to_local(h, zone)) == hour)).cast("double")


def market_gate(date: Column, zone: Zone) -> Column:
    """UTC instant of noon market time on the day before delivery."""
    noon = F.timestamp_add("HOUR", F.lit(12), F.date_sub(date, 1).cast("timestamp_ntz"))
    return to_utc(noon, zone)


def delivery_hours(days: DataFrame, zone: Zone, date: str = "delivery_date") -> DataFrame:
    """Clock cells of local days: local_hour, delivery_start_utc, delivery_duration_hours.

    The repeated autumn hour is one cell of two hours; a spring day has 23 cells.
    """
    start, end = day_start(F.col(date), zone), day_start(F.date_add(F.col(date), 1), zone)
    hours = F.sequence(start, F.timestamp_add("HOUR", F.lit(-1), end), F.expr("interval 1 hour"))
    cells = days.select(date).distinct().withColumn("ts_utc", F.explode(hours))
    return (
        cells.withColumn("local_hour", F.hour(to_local(F.col("ts_utc"), zone)).cast("int"))
        .groupBy(date, "local_hour")
        .agg(F.min("ts_utc").alias("delivery_start_utc"), F.count(F.lit(1)).cast("double").alias("delivery_duration_hours"))
    )
