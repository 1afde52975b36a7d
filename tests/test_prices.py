import datetime as dt

import pytest
from .frames import HOUR, generation, one, prices, utc
from pyspark.sql import functions as F

from wattline.functions.timeaxis import DE_LU, attach_local_time, delivery_hours, get_zone, period_label
from wattline.operators.intervals import cadence_by_day, hourly_mean, with_cadence
from wattline.operators.prices import block_prices, capture_rate, daily_price_segments, generation_mix, hourly_shape, intraday_spread, negative_share
from wattline.operators.quality import inspect


def test_weights_by_interval_length(spark):
    rows = prices(spark, [(utc(2026, 6, 1), -100, 60), (utc(2026, 6, 1, 1), 100, 15)])
    assert one(negative_share(rows, DE_LU, "all"))["negative_pct"] == pytest.approx(80)
    assert one(block_prices(rows, DE_LU, "all"))["all_hours"] == pytest.approx(-60)


def test_block_prices_of_a_weekday(spark):
    start = utc(2026, 6, 14, 22)  # Monday 2026-06-15 local
    rows = prices(spark, [(start + h * HOUR, 100 if 8 <= h < 20 else 20) for h in range(24)])
    found = one(block_prices(rows, DE_LU, "day"))
    assert (found["on_peak"], found["off_peak"], found["spread"], found["n_on_peak"], found["n_off_peak"]) == (100, 20, 80, 12, 12)
    assert found["period"] == "2026-06-15"


def test_missing_block_is_null(spark):
    found = one(block_prices(prices(spark, [(utc(2026, 6, 15, 0), 5)]), DE_LU, "all"))
    assert found["on_peak"] is None and found["spread"] is None and found["off_peak"] == 5


def test_range_against_block_spread(spark):
    start = utc(2026, 6, 14, 22)
    level = lambda h: 10 if 8 <= h < 14 else 40 if 14 <= h < 20 else 90 if h == 20 else 60
    rows = prices(spark, [(start + h * HOUR, level(h)) for h in range(24)])
    assert one(block_prices(rows, DE_LU, "all"))["on_peak"] == pytest.approx(25)
    assert one(block_prices(rows, DE_LU, "all"))["spread"] < 0
    assert one(intraday_spread(rows, DE_LU, "all"))["mean_spread"] == 80
    short = rows.where(F.col("ts_utc") >= utc(2026, 6, 15, 1))  # 21 hours
    assert intraday_spread(short, DE_LU, "all").count() == 0


def test_capture_rate(spark):
    start = utc(2026, 6, 14, 22)
    rows = prices(spark, [(start + h * HOUR, 100 if h < 6 else 20) for h in range(12)])
    sun = generation(spark, [(start + h * HOUR, 0 if h < 6 else 10) for h in range(12)])
    found = one(capture_rate(rows, sun, DE_LU, "solar", "all"))
    assert found["capture_price"] == pytest.approx(20) and found["baseload_price"] == pytest.approx(60)
    assert found["capture_rate"] == pytest.approx(1 / 3)


def test_capture_uses_exact_overlaps_and_leaves_gaps(spark):
    start = utc(2026, 6, 15)
    rows = prices(spark, [(start, 20), (start + 2 * HOUR, 100)])
    sun = generation(spark, [(start + h * dt.timedelta(minutes=30), 10, 30) for h in range(6)])
    found = one(capture_rate(rows, sun, DE_LU, "solar", "all"))
    assert found["energy_mwh"] == pytest.approx(20) and found["capture_price"] == pytest.approx(60)


def test_capture_in_the_repeated_autumn_hour(spark):
    rows = prices(spark, [(utc(2025, 10, 26, 0), 0), (utc(2025, 10, 26, 1), 100)])
    sun = generation(spark, [(utc(2025, 10, 26, 0), 1), (utc(2025, 10, 26, 1), 9)])
    found = one(capture_rate(rows, sun, DE_LU, "solar", "all"))
    assert found["capture_price"] == pytest.approx(90) and found["capture_rate"] == pytest.approx(1.8)


def test_capture_without_energy_is_null(spark):
    found = one(capture_rate(prices(spark, [(utc(2026, 1, 1), 5)]), generation(spark, [(utc(2026, 1, 1), 0)]), DE_LU, "solar", "all"))
    assert found["capture_price"] is None and found["capture_rate"] is None


def test_mix_leaves_out_imports(spark):
    both = generation(spark, [(utc(2026, 1, 1), 30)]).unionByName(generation(spark, [(utc(2026, 1, 1), 10)], "wind")).unionByName(generation(spark, [(utc(2026, 1, 1), 99)], "imports"))
    shares = {r["fuel"]: r["share_pct"] for r in generation_mix(both, DE_LU, "all").collect()}
    assert shares == {"solar": 75.0, "wind": 25.0}


def test_shape_counts_the_repeated_hour_twice(spark):
    rows = prices(spark, [(utc(2025, 10, 26, 0), 10), (utc(2025, 10, 26, 1), 30)])
    found = one(hourly_shape(rows, DE_LU, "year"))
    assert (found["local_hour"], found["price"], found["observed_hours"]) == (2, 20, 2)


def test_segments_rise_after_gaps(spark):
    rows = prices(spark, [(utc(2026, 1, d, 12), 1) for d in (1, 2, 5, 6, 9)])
    assert [r["segment"] for r in daily_price_segments(rows, DE_LU).orderBy("date").collect()] == [0, 0, 1, 1, 2]


def test_local_days_have_23_24_25_hours(spark):
    days = spark.sql("select explode(array(date'2025-03-30', date'2025-06-01', date'2025-10-26')) delivery_date")
    cells = delivery_hours(days, DE_LU).groupBy("delivery_date").agg(F.count(F.lit(1)).alias("n"), F.sum("delivery_duration_hours").alias("h"))
    assert [(r["n"], r["h"]) for r in cells.orderBy("delivery_date").collect()] == [(23, 23), (24, 24), (24, 25)]


def test_bad_inputs_raise(spark):
    with pytest.raises(ValueError):
        period_label("week")
    with pytest.raises(KeyError):
        get_zone("XX")
    with pytest.raises(TypeError):
        attach_local_time(spark.sql("select timestamp'2026-01-01 00:00:00' ts_utc"), DE_LU)


def quarter(spark, values, start=utc(2026, 1, 1), minutes=15):
    return prices(spark, [(start + i * dt.timedelta(minutes=15), v, minutes) for i, v in enumerate(values)])


def test_hourly_mean_of_quarters(spark):
    found = one(hourly_mean(quarter(spark, [-40, 0, 40, 80]), DE_LU, "price"))
    assert found["price"] == 20 and found["covered_hours"] == 1


@pytest.mark.parametrize("fault", ["gap", "duplicate", "null", "overlap", "resolution"])
def test_faulty_hours_are_dropped(spark, fault):
    rows = [(utc(2026, 1, 1, 0, 15 * i), 1.0, 15) for i in range(4)]
    if fault == "gap":
        rows.pop(1)
    elif fault == "duplicate":
        rows.append(rows[0])
    elif fault == "null":
        rows[2] = (rows[2][0], None, 15)
    elif fault == "overlap":
        rows[1] = (utc(2026, 1, 1, 0, 10), 1.0, 15)
    else:
        rows[3] = (rows[3][0], 1.0, 30)
    assert hourly_mean(prices(spark, rows), DE_LU, "price").count() == 0


def test_hourly_mean_around_clock_changes(spark):
    spring = prices(spark, [(utc(2025, 3, 29, 23) + h * HOUR, h) for h in range(23)])
    autumn = prices(spark, [(utc(2025, 10, 25, 22) + h * HOUR, h) for h in range(25)])
    assert hourly_mean(spring, DE_LU, "price").count() == 23
    cells = hourly_mean(autumn, DE_LU, "price")
    assert cells.count() == 24
    assert one(cells.where("local_hour = 2"))["covered_hours"] == 2
    half = autumn.where(F.col("ts_utc") != utc(2025, 10, 26, 1))
    assert hourly_mean(half, DE_LU, "price").where("local_hour = 2").count() == 0


def test_cadence(spark):
    rows = prices(spark, [(utc(2026, 1, 1, h), 0) for h in range(5, 20)] + [(utc(2026, 1, 2, 12), 0)])
    assert [r["resolution_min"] for r in cadence_by_day(rows, DE_LU).orderBy("day").collect()] == [60, 60]
    with pytest.raises(ValueError, match="duplicate"):
        with_cadence(rows.unionByName(rows), DE_LU)
    with pytest.raises(ValueError, match="single"):
        with_cadence(prices(spark, [(utc(2026, 1, 1), 0)]), DE_LU)
    with pytest.raises(ValueError, match="irregular"):
        with_cadence(prices(spark, [(utc(2026, 1, 1, 9, m), 0) for m in (0, 15, 40)]), DE_LU)


def test_audit(spark):
    rows = prices(spark, [(utc(2026, 1, 1, 0), 1), (utc(2026, 1, 1, 2), 1)])
    found = one(inspect(rows, "price"))
    assert (found["invalid"], found["gap_hours"]) == (0, 1) and found["coverage_pct"] == pytest.approx(200 / 3)
    bad = prices(spark, [(utc(2026, 1, 1, 0), 1), (utc(2026, 1, 1, 0, 30), float("nan")), (utc(2026, 1, 1, 5), None)])
    assert one(inspect(bad, "price"))["invalid"] == 3  # overlap, NaN off the hour, null
