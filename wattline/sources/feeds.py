"""Provider payloads (JSON with parallel arrays) -> canonical facts, as DataFrame operations.

Payloads are rows of ``payload string``; a reader of saved files and a batch data source
for the HTTP interface both produce them. Payloads may overlap, as every run reads the last
days again: each is turned into facts by itself, and of several that give one interval the
latest counts - by ``stamp`` (a file's modification time), then ``file``, then ``place`` in
the file, then content.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.expr import require
from wattline.functions.timeaxis import Zone, utc_literal
from wattline.operators.intervals import with_cadence

from .contracts import conform
from .http import http_payloads

#: The provider's generation labels and the fuels they are summed into.
FUEL_OF_LABEL = {
    "Hydro Run-of-River": "hydro",
    "Hydro water reservoir": "hydro",
    "Hydro pumped storage": "hydro_pumped_storage",
    "Hydro pumped storage consumption": "hydro_pumped_storage",
    "Biomass": "biomass",
    "Fossil brown coal / lignite": "coal",
    "Fossil hard coal": "coal",
    "Fossil peat": "coal",
    "Fossil oil": "oil",
    "Fossil oil shale": "oil",
    "Fossil coal-derived gas": "gas",
    "Fossil gas": "gas",
    "Geothermal": "geothermal",
    "Nuclear": "nuclear",
    "Waste": "waste",
    "Wind offshore": "wind",
    "Wind onshore": "wind",
    "Solar": "solar",
    "Battery Storage (Power)": "battery",
    "Battery": "battery",
    "Battery Consumption": "battery",
    "Other renewables": "other",
    "Others": "other",
    "Other": "other",
    "Cross border electricity trading": "imports",
}
#: Load under its two definitions, and series that repeat others.
LOAD_LABELS = ("Load", "Load (incl. self-consumption)")
DERIVED_LABELS = ("Residual load", "Renewable share of load", "Renewable share of generation")
FORECAST_SERIES = {"load": "load", "wind_onshore": "wind", "wind_offshore": "wind", "solar": "solar"}
PRICE_UNIT = "EUR / MWh"

PRICE_PAYLOAD = "unix_seconds array<bigint>, price array<double>, unit string"
POWER_PAYLOAD = "unix_seconds array<bigint>, production_types array<struct<name:string,data:array<double>>>"
FORECAST_PAYLOAD = "unix_seconds array<bigint>, forecast_values array<double>, production_type string"
CAPACITY_PAYLOAD = "time array<string>, production_types array<struct<name:string,data:array<double>>>"


class UpstreamError(ValueError):
    """The provider sent something that must be looked at by a person."""


#: Line ends between two documents of a file; inside one no brace opens right after one closes.
_BETWEEN = r"(?<=\})[ \t]*[\r\n]\s*(?=\{)"


def saved_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document of the saved files: its file, its place there and its text.

    A file holds one document or several, each from a new line on and over any number of lines.
    """
    rows = spark.read.text(path, wholetext=True)
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("stamp"), F.split("value", _BETWEEN).alias("documents"))
    return named.select("file", "stamp", F.posexplode("documents").alias("place", "payload"))


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """The fields of each payload and its ``turn``: of two payloads the one with the larger turn is later."""
    order = [F.col(c) for c in ("stamp", "file", "place") if c in payloads.columns]
    turn = F.struct(*order, F.sha2("payload", 256).alias("content"))
    parsed = payloads.select(turn.alias("turn"), F.from_json("payload", schema).alias("p")).select("turn", "p.*")
    if "unix_seconds" in parsed.columns:
        repeated = F.size("unix_seconds") > F.size(F.array_distinct("unix_seconds"))
        require(parsed, F.coalesce(repeated, F.lit(False)), "duplicate timestamps in the provider's response")
    return parsed


def _latest(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """One row per key: the value that the latest payload gives."""
    return rows.groupBy(*keys).agg(F.max_by(value, "turn").alias(value))


def _stamp(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))


def _points(frame: DataFrame, values: str, *others: str) -> DataFrame:
    """One row per non-null value of parallel arrays; the shorter array ends both."""
    zipped = F.explode(F.arrays_zip(F.col("unix_seconds").alias("s"), F.col(values).alias("v"))).alias("z")
    return frame.select(*others, zipped).select(*others, _stamp(F.col("z.s")).alias("ts_utc"), F.col("z.v").alias("value")).where("value is not null and ts_utc is not null")


def _finished(rows: DataFrame, axis: DataFrame, zone: Zone, name: str, start: dt.datetime | None, end: dt.datetime | None, source: str) -> DataFrame:
    """Cadence measured on the whole axis, half-open trim, provenance, contract order."""
    trimmed = rows
    if start:
        trimmed = trimmed.where(F.col("ts_utc") >= utc_literal(start))
    if end:
        trimmed = trimmed.where(F.col("ts_utc") < utc_literal(end))
    joined = trimmed.join(with_cadence(axis, zone), "ts_utc").withColumn("zone", F.lit(zone.code)).withColumn("source", F.lit(source))
    return conform(joined, name)


def _axis(frame: DataFrame) -> DataFrame:
    """The stamps of all payloads, each once."""
    return frame.select(F.explode("unix_seconds").alias("s")).select(_stamp(F.col("s")).alias("ts_utc")).distinct()


def price_facts(payloads: DataFrame, zone: Zone, start=None, end=None, source: str = "feed") -> DataFrame:
    parsed = _parsed(payloads, PRICE_PAYLOAD)
    require(parsed, (F.size("unix_seconds") > 0) & ~F.coalesce(F.col("unit") == PRICE_UNIT, F.lit(False)), f"prices must be in {PRICE_UNIT}")
    rows = _latest(_points(parsed, "price", "turn"), ("ts_utc",), "value").withColumnRenamed("value", "price").withColumn("currency", F.lit(zone.currency))
    return _finished(rows, _axis(parsed), zone, "price", start, end, source)


def _labelled(parsed: DataFrame) -> DataFrame:
    series = parsed.select("turn", "unix_seconds", F.explode("production_types").alias("t")).select("turn", "unix_seconds", F.col("t.name").alias("label"), F.col("t.data").alias("data"))
    return _points(series, "data", "turn", "label")


def load_facts(payloads: DataFrame, zone: Zone, start=None, end=None, source: str = "feed") -> DataFrame:
    """Per payload, load on the generation boundary where it lists it, else including self-consumption."""
    parsed = _parsed(payloads, POWER_PAYLOAD)
    wanted = F.when(F.array_contains("production_types.name", LOAD_LABELS[0]), LOAD_LABELS[0]).otherwise(LOAD_LABELS[1])
    chosen = parsed.withColumn("production_types", F.filter("production_types", lambda t: t["name"] == wanted))
    loads = _labelled(chosen).groupBy("turn", "ts_utc").agg(F.sum("value").alias("load_mw"))
    return _finished(_latest(loads, ("ts_utc",), "load_mw"), _axis(parsed), zone, "load", start, end, source)


def generation_facts(payloads: DataFrame, zone: Zone, start=None, end=None, source: str = "feed") -> DataFrame:
    """Labels summed into fuels; unknown labels, or net and gross battery together, raise."""
    parsed = _parsed(payloads, POWER_PAYLOAD)
    labels = parsed.select(F.explode("production_types.name").alias("label")).distinct()
    known = [*FUEL_OF_LABEL, *LOAD_LABELS, *DERIVED_LABELS]
    require(labels, ~F.col("label").isin(*known), "unrecognised generation series; review its units")
    listed = F.col("production_types.name")
    both = F.array_contains(listed, "Battery Storage (Power)") & F.arrays_overlap(listed, F.array(F.lit("Battery"), F.lit("Battery Consumption")))
    require(parsed, F.coalesce(both, F.lit(False)), "net and gross battery series published together")
    fuel = F.create_map(*[F.lit(x) for pair in FUEL_OF_LABEL.items() for x in pair])[F.col("label")]
    rows = _labelled(parsed).withColumn("fuel", fuel).where("fuel is not null")
    fuels = rows.groupBy("turn", "ts_utc", "fuel").agg(F.sum("value").alias("gen_mw"))
    return _finished(_latest(fuels, ("ts_utc", "fuel"), "gen_mw"), _axis(parsed), zone, "generation", start, end, source)


def fundamentals_facts(payloads: DataFrame, zone: Zone, start=None, end=None, source: str = "feed") -> DataFrame:
    """Day-ahead series; wind only where both of its components are present."""
    parsed = _parsed(payloads, FORECAST_PAYLOAD)
    series = F.create_map(*[F.lit(x) for pair in FORECAST_SERIES.items() for x in pair])[F.col("production_type")]
    rows = _latest(_points(parsed, "forecast_values", "turn", "production_type"), ("ts_utc", "production_type"), "value").withColumn("series", series).where("series is not null")
    wanted = F.when(F.col("series") == "wind", 2).otherwise(1)
    whole = rows.groupBy("ts_utc", "series").agg(F.sum("value").alias("forecast_mw"), F.count(F.lit(1)).alias("parts"))
    whole = whole.where(F.col("parts") == wanted).select("ts_utc", "series", "forecast_mw")
    return _finished(whole, _axis(parsed), zone, "fundamentals", start, end, source)


def installed_power(payloads: DataFrame, zone: Zone, time_step: str = "yearly", source: str = "feed") -> DataFrame:
    """Capacity per technology, labelled by period end; planned series stay apart."""
    if time_step not in ("yearly", "monthly"):
        raise ValueError(f"time_step must be 'yearly' or 'monthly', got {time_step!r}")
    parsed = _parsed(payloads, CAPACITY_PAYLOAD).select("turn", "time", F.explode("production_types").alias("t"))
    rows = parsed.select("turn", F.col("t.name").alias("technology"), F.explode(F.arrays_zip(F.col("time").alias("period"), F.col("t.data").alias("value"))).alias("z"))
    rows = _latest(rows.select("turn", "technology", "z.period", "z.value").where("value is not null and period is not null"), ("technology", "period"), "value")
    as_of = F.make_date(F.col("period").cast("int"), F.lit(12), F.lit(31)) if time_step == "yearly" else F.last_day(F.to_date("period", "MM.yyyy"))
    unit = F.when(F.col("technology") == "Battery storage (capacity)", "GWh").otherwise("GW")
    planned = F.contains(F.lower("technology"), F.lit("planned"))
    return rows.select(F.lit(zone.country.upper()).alias("country"), F.lit(time_step).alias("time_step"), "period", as_of.alias("as_of"), "technology", "value", unit.alias("unit"), planned.alias("is_planned"), F.lit(source).alias("source"))


READERS: dict[str, Callable[..., DataFrame]] = {"price": price_facts, "load": load_facts, "generation": generation_facts, "fundamentals": fundamentals_facts}


def facts(name: str, payloads: DataFrame, zone: Zone, **bounds) -> DataFrame:
    if name not in READERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(READERS)}")
    return READERS[name](payloads, zone, **bounds)


def chunks(start: dt.datetime, end: dt.datetime, days: int) -> Iterable[tuple[dt.datetime, dt.datetime]]:
    """Half-open windows of whole days that tile [start, end)."""
    step = dt.timedelta(days=max(1, days))
    while start < end:
        yield start, min(end, start + step)
        start += step


#: A source turns (spark, place, dataset, zone, start, end) into payloads.
Source = Callable[[SparkSession, str, str, Zone, dt.datetime, dt.datetime], DataFrame]


def _files(spark: SparkSession, place: str, dataset: str, zone: Zone, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return saved_payloads(spark, f"{place.rstrip('/')}/{dataset}")


SOURCES: dict[str, Source] = {"files": _files, "http": http_payloads}


def get_source(name: str) -> Source:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    return SOURCES[name]


def fetcher(spark: SparkSession, source: str, place: str) -> Callable[[str, Zone, dt.datetime, dt.datetime], DataFrame]:
    """A fetch function for ``ingest``: facts of a dataset and window from saved files or the HTTP interface."""
    payloads = get_source(source)

    def fetch(dataset: str, zone: Zone, start: dt.datetime, end: dt.datetime) -> DataFrame:
        return facts(dataset, payloads(spark, place, dataset, zone, start, end), zone, start=start, end=end)

    return fetch
