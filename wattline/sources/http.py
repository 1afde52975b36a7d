"""HTTP JSON as a batch data source: one partition per request, retried within limits."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wattline.functions.timeaxis import Zone

#: Fixed values of the retry policy.
ATTEMPTS = 6
FIRST_WAIT = 1.5
THROTTLED_WAIT = 20.0
LONGEST_WAIT = 120.0
RETRIED = frozenset({429, 500, 502, 503, 504})


class SourceError(RuntimeError):
    """A request that failed for good."""


def wait_before(attempt: int, status: int | None, retry_after: str | None) -> float:
    """Seconds to wait after failed attempt ``attempt`` (from 1)."""
    if status == 429:
        try:
            return min(LONGEST_WAIT, float(retry_after or ""))
        except ValueError:
            return min(LONGEST_WAIT, THROTTLED_WAIT * attempt)
    return min(LONGEST_WAIT, FIRST_WAIT * 2 ** (attempt - 1))


def fetch(url: str, opened: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> str:
    """Body of a JSON response; other client errors fail at once."""
    status: int | None = None
    for attempt in range(1, ATTEMPTS + 1):
        after = None
        try:
            with opened(url, timeout=120) as response:
                text = response.read().decode("utf-8")
            if not isinstance(json.loads(text), dict):
                raise SourceError(f"{url}: expected a JSON object")
            return text
        except ValueError as error:  # not JSON, or not text at all
            raise SourceError(f"{url}: the body is not JSON") from error
        except urllib.error.HTTPError as error:
            status, after = error.code, error.headers.get("Retry-After") if error.headers else None
            if status not in RETRIED:
                raise SourceError(f"{url}: HTTP {status}") from error
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            status = None
        if attempt < ATTEMPTS:
            sleep(wait_before(attempt, status, after))
    raise SourceError(f"{url}: gave up after {ATTEMPTS} attempts (last status {status})")


class _Request(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        base, listed = options["url"], json.loads(options.get("requests", "[{}]"))
        self.urls = [base + ("?" + urllib.parse.urlencode(r) if r else "") for r in listed]

    def partitions(self) -> list[InputPartition]:
        return [_Request(u) for u in self.urls]

    def read(self, partition: _Request) -> Iterator[tuple[str, str]]:
        yield partition.url, fetch(partition.url)


class JsonHttpSource(DataSource):
    """``spark.read.format("json_http").option("url", ...).option("requests", "[{...}]")``."""

    @classmethod
    def name(cls) -> str:
        return "json_http"

    def schema(self) -> str:
        return "file string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


#: The provider's paths per dataset, and how a zone is named there.
ENDPOINTS = {"price": "/price", "load": "/public_power", "generation": "/public_power", "fundamentals": "/public_power_forecast"}
FORECAST_TYPES = ("load", "wind_onshore", "wind_offshore", "solar")


def requests_for(dataset: str, zone: Zone, start: dt.datetime, end: dt.datetime) -> list[dict[str, str]]:
    """Query parameters of the requests that cover [start, end); the provider's end is inclusive."""
    if dataset not in ENDPOINTS:
        raise KeyError(f"unknown dataset {dataset!r}; known: {sorted(ENDPOINTS)}")
    span = {"start": start.date().isoformat(), "end": end.date().isoformat()}
    if dataset == "price":
        return [{"bzn": zone.code, **span}]
    if dataset == "fundamentals":
        return [{"country": zone.country, "production_type": t, "forecast_type": "day-ahead", **span} for t in FORECAST_TYPES]
    return [{"country": zone.country, **span}]


def http_payloads(spark: SparkSession, base: str, dataset: str, zone: Zone, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Payloads of a window straight from the provider, one partition per request."""
    spark.dataSource.register(JsonHttpSource)
    asked = json.dumps(requests_for(dataset, zone, start, end))
    return spark.read.format(JsonHttpSource.name()).option("url", base.rstrip("/") + ENDPOINTS[dataset]).option("requests", asked).load()
