"""Declared schemas of the four fact tables, and their checks as one violations query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.expr import is_finite

#: Fixed values of the data model.
FUELS = ("coal", "gas", "oil", "nuclear", "hydro", "hydro_pumped_storage", "wind", "solar", "biomass", "geothermal", "waste", "battery", "other", "imports")
SERIES = ("load", "wind", "solar")
RESOLUTIONS = (1, 5, 15, 30, 60)


@dataclass(frozen=True)
class Contract:
    """One fact table: its own columns, key, and range checks (name -> test of a good row)."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    key: tuple[str, ...]
    value: str
    low: float
    high: float
    label: str | None = None
    labels: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField("zone", T.StringType()), T.StructField("ts_utc", T.TimestampNTZType()), T.StructField("resolution_min", T.ShortType())]
        fields += [T.StructField(n, kind) for n, kind in self.columns]
        return T.StructType([*fields, T.StructField("source", T.StringType())])

    def checks(self) -> dict[str, Column]:
        found = {
            "zone": F.length("zone").between(2, 32),
            "ts_utc": F.col("ts_utc").isNotNull(),
            "resolution_min": F.col("resolution_min").isin(*RESOLUTIONS),
            "source": F.col("source").isNotNull(),
            self.value: is_finite(F.col(self.value)) & F.col(self.value).between(self.low, self.high),
        }
        if self.label:
            found[self.label] = F.col(self.label).isin(*self.labels)
        if self.name == "price":
            found["currency"] = F.length("currency") == 3
        return found


_DOUBLE, _STRING = T.DoubleType(), T.StringType()
CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        Contract("price", (("price", _DOUBLE), ("currency", _STRING)), ("zone", "ts_utc"), "price", -10_000, 100_000),
        Contract("load", (("load_mw", _DOUBLE),), ("zone", "ts_utc"), "load_mw", 0, 2_000_000),
        Contract("generation", (("fuel", _STRING), ("gen_mw", _DOUBLE)), ("zone", "ts_utc", "fuel"), "gen_mw", -200_000, 2_000_000, "fuel", FUELS),
        Contract("fundamentals", (("series", _STRING), ("forecast_mw", _DOUBLE)), ("zone", "ts_utc", "series"), "forecast_mw", -50_000, 2_000_000, "series", SERIES),
    )
}


def contract(name: str) -> Contract:
    if name not in CONTRACTS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(CONTRACTS)}")
    return CONTRACTS[name]


def empty_frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], contract(name).schema)


def conform(frame: DataFrame, name: str) -> DataFrame:
    """Columns of the contract in order and type; unknown or missing columns raise."""
    schema = contract(name).schema
    extra, missing = set(frame.columns) - set(schema.names), set(schema.names) - set(frame.columns)
    if extra or missing:
        raise ValueError(f"{name}: missing columns {sorted(missing)}, unexpected columns {sorted(extra)}")
    return frame.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def violations(frame: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, rule, violations), per group of the columns ``by``: all failures at once; null counts as a failure."""
    c = contract(name)
    bad = [F.count_if(~F.coalesce(test, F.lit(False))).alias(f"rule_{rule}") for rule, test in c.checks().items()]
    counted = frame.groupBy(*by).agg(*bad)
    rules = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"rule_{rule}").alias("violations")) for rule in c.checks()]))
    listed = counted.select(*by, rules.alias("x")).select(*by, "x.*")
    keys = [*by, *[k for k in c.key if k not in by]]
    repeated = frame.groupBy(*keys).count().groupBy(*by).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    listed = listed.unionByName(repeated.select(*by, F.lit("unique_key").alias("rule"), "violations"))
    return listed.select(F.lit(name).alias("dataset"), *by, "rule", F.col("violations").cast("long"))


def validated(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` conformed to its contract; raises with every broken rule."""
    conformed = conform(frame, name)
    broken = violations(conformed, name).where("violations > 0").collect()  # one row per rule
    if broken:
        raise ValueError(f"{name}: " + ", ".join(f"{r['rule']} ({r['violations']})" for r in broken))
    return conformed
