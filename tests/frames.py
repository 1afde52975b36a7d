"""Small hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

HOUR = dt.timedelta(hours=1)


def utc(y, m, d, h=0, minute=0):
    return dt.datetime(y, m, d, h, minute)


def prices(spark, rows, minutes=60):
    """rows: (ts, price) or (ts, price, minutes)."""
    full = [("DE-LU", r[0], r[2] if len(r) > 2 else minutes, None if r[1] is None else float(r[1])) for r in rows]
    frame = spark.createDataFrame(full, "zone string, ts_utc timestamp_ntz, resolution_min int, price double")
    return frame.withColumn("resolution_min", F.col("resolution_min").cast("short"))


def generation(spark, rows, fuel="solar", minutes=60):
    full = [("DE-LU", r[0], r[2] if len(r) > 2 else minutes, fuel, float(r[1])) for r in rows]
    return spark.createDataFrame(full, "zone string, ts_utc timestamp_ntz, resolution_min int, fuel string, gen_mw double")


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()
