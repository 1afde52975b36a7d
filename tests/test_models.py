import datetime as dt

import numpy as np
import pytest
from .frames import one
from pyspark.sql import functions as F

from wattline.functions.timeaxis import DE_LU
from wattline.operators import pit, trees
from wattline.operators.models import alpha_search, naive_forecasts, ridge_coefficients, ridge_predict_day, ridge_walk_forward, ridge_weights
from wattline.operators.scoring import metric_columns, scoreboard, with_quantiles, with_regime
from wattline.plans.backtest import InsufficientHistory, run
from wattline.plans.panel import Panel, build_panel, price_features


def cells(spark, days=45, hours=(3, 14)):
    start, rows = dt.date(2025, 1, 1), []
    for day in range(days):
        for hour in hours:
            x = (7 * day + hour) % 19 - 9
            rows.append((start + dt.timedelta(days=day), hour, float(x * x - 10 + day / 20), float(day), float(day - 7), float(day - 2)))
    return spark.createDataFrame(rows, "local_date date, local_hour int, price double, price_d1 double, price_d7 double, price_similar_day double")


def standardised(x, y, alpha):
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z / len(x) + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(x)) / x.std(0)
    return [y.mean() - x.mean(0) @ w, *w]


def test_ridge_drops_a_constant_feature():
    assert np.allclose(ridge_weights(np.full((4, 1), 2.0), np.array([4.0, 5, 5, 6]), 0.1), [5, 0])
    x = np.column_stack([np.arange(30.0), np.full(30, 0.1)])
    assert np.allclose(ridge_weights(x, 3 * x[:, 0], 0.0), [0, 3, 0])


def test_ridge_keeps_small_spreads_of_large_levels():
    rng = np.random.default_rng(5)
    for level, spread in ((1e5, 1.0), (1e6, 0.01), (-1e7, 0.1)):
        x = level + spread * rng.normal(size=(80, 1))
        y = 3 * (x[:, 0] - level) + 0.01 * rng.normal(size=80)
        found = ridge_weights(x, y, 0.1)
        assert found[1] == pytest.approx(standardised(x - level, y, 0.1)[1], rel=1e-4) and found[1] > 2
    still = 1e5 + 1e-5 * rng.normal(size=(80, 1))  # below a billionth of its level
    assert ridge_weights(still, rng.normal(size=80), 0.1)[1] == 0


def test_ridge_equals_an_independent_solution():
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(60, 4)) * [1, 10, 0.1, 3] + 5, 60
    y = x @ [1, -2, 3, 0.5] + rng.normal(size=60)
    assert np.allclose(ridge_weights(x, y, 0.3), standardised(x, y, 0.3))


def test_batched_refits_equal_fresh_fits_and_never_see_the_future(spark):
    panel = cells(spark)
    walked = {(r[0], r[1]): r[2] for r in ridge_walk_forward(panel, ["price_d1", "price_d7"], min_train_rows=10).collect()}
    rows = sorted(r for r in panel.where("local_hour = 3").collect())
    for i in (10, 20, 44):
        past = rows[:i]
        x = np.array([[r["price_d1"], r["price_d7"]] for r in past])
        y = np.array([r["price"] for r in past])
        w = ridge_weights(x, y, 0.1)
        assert walked[(rows[i]["local_date"], 3)] == pytest.approx(float(w @ [1, rows[i]["price_d1"], rows[i]["price_d7"]]))
    changed = panel.withColumn("price", F.when(F.col("local_date") >= dt.date(2025, 2, 1), 999.0).otherwise(F.col("price")))
    again = {(r[0], r[1]): r[2] for r in ridge_walk_forward(changed, ["price_d1", "price_d7"], min_train_rows=10).collect()}
    early = [k for k in walked if k[0] <= dt.date(2025, 2, 1)]
    assert early and all(walked[k] == again[k] for k in early)


def test_rolling_window_refits(spark):
    full = ridge_walk_forward(cells(spark), ["price_d1"], min_train_rows=10, window=12).where("local_hour = 14").orderBy("local_date").collect()
    rows = sorted(cells(spark).where("local_hour = 14").collect())
    x = np.array([[r["price_d1"]] for r in rows[18:30]])
    w = ridge_weights(x, np.array([r["price"] for r in rows[18:30]]), 0.1)
    assert full[20]["forecast"] == pytest.approx(float(w @ [1, rows[30]["price_d1"]]))
    with pytest.raises(ValueError, match="at least 10"):
        ridge_walk_forward(cells(spark), ["price_d1"], min_train_rows=10, window=9)


def test_zones_do_not_mix(spark):
    two = cells(spark).withColumn("zone", F.lit("A")).unionByName(cells(spark).withColumn("price", F.col("price") * 10 + 5).withColumn("zone", F.lit("B")))
    found = {(r["zone"], r["local_date"], r["local_hour"]): r["forecast"] for r in ridge_walk_forward(two, ["price_d1"], min_train_rows=10).collect()}
    alone = {(r[0], r[1]): r[2] for r in ridge_walk_forward(cells(spark), ["price_d1"], min_train_rows=10).collect()}
    assert len(found) == 2 * len(alone) and all(found[("A", *k)] == pytest.approx(v) and found[("B", *k)] == pytest.approx(10 * v + 5) for k, v in alone.items())


def test_a_day_is_forecast_without_its_target(spark):
    day = dt.date(2025, 2, 1)
    walked = {r["local_hour"]: r["forecast"] for r in ridge_walk_forward(cells(spark), ["price_d1"], min_train_rows=10, start=day, end=day).collect()}
    blind = cells(spark).withColumn("price", F.when(F.col("local_date") < F.lit(day), F.col("price")))
    found = {r["local_hour"]: r["forecast"] for r in ridge_predict_day(blind, ["price_d1"], day, min_train_rows=10).collect()}
    assert found == pytest.approx(walked) and set(found) == {3, 14}
    assert ridge_predict_day(blind.withColumn("price_d1", F.when(F.col("local_hour") == 3, F.col("price_d1"))), ["price_d1"], day, min_train_rows=10).count() == 1
    assert ridge_predict_day(blind, ["price_d1"], day, min_train_rows=99).count() == 0


def test_alpha_search_and_coefficients(spark):
    found = alpha_search(cells(spark), ["price_d1"], dt.date(2025, 1, 20), dt.date(2025, 2, 10), min_train_rows=5)
    assert found.count() == 7 and {r["n"] for r in found.collect()} == {44}
    assert ridge_coefficients(cells(spark), ["price_d1"]).count() == 2
    assert ridge_coefficients(cells(spark), ["price_d1"], before=dt.date(2025, 1, 2)).count() == 0


def test_trees_learn_and_grow_by_leaves():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (600, 3))
    y = np.where(x[:, 0] > 0.2, 5.0, 0.0) + np.where(x[:, 1] > 0, 2.0, 0.0) + 0.1 * rng.normal(size=600)
    model = trees.fit_boosted(x, y, trees.TreeSettings(rounds=60, leaves=4, rate=0.2, least_rows=10))
    assert np.abs(model.predict(x) - y).mean() < 0.3
    assert all(sum(n[0] < 0 for n in nodes) <= 4 for nodes in model.trees) and model.trees[0][0][0] == 0
    still = trees.fit_boosted(np.ones((50, 1)), np.arange(50.0), trees.TreeSettings(rounds=2))
    assert (still.predict(np.ones((3, 1))) == 24.5).all()
    for broken in ({"rounds": 0}, {"leaves": 1}, {"rate": 0.0}, {"ridge": -1.0}):
        with pytest.raises(ValueError):
            trees.TreeSettings(**broken)


def test_trees_walk_forward_without_the_future(spark):
    settings, first = trees.TreeSettings(rounds=3, leaves=3, least_rows=5), dt.date(2025, 2, 1)
    walk = lambda panel, **more: {(r[0], r[1]): r[2] for r in trees.boosted_forecasts(panel, ["price_d1", "price_d7"], first, settings=settings, min_train_days=10, **more).collect()}
    found = walk(cells(spark))
    assert min(found)[0] == first and len(found) == 28
    changed = cells(spark).withColumn("price", F.when(F.col("local_date") >= dt.date(2025, 2, 5), 999.0).otherwise(F.col("price")))
    again, blocks = walk(changed), walk(cells(spark), blocks=3)
    assert blocks == found and all(again[k] == v for k, v in found.items() if k[0] <= dt.date(2025, 2, 5)) and again != found
    weekly = walk(cells(spark), refit_every_days=7)
    assert weekly != found and {k: v for k, v in weekly.items() if k[0] == first} == {k: v for k, v in found.items() if k[0] == first}
    assert {(r[0], r[1]): r[2] for r in trees.boosted_day(changed, ["price_d1", "price_d7"], dt.date(2025, 2, 5), settings=settings, min_train_days=10).collect()} == {k: v for k, v in found.items() if k[0] == dt.date(2025, 2, 5)}
    best, search = trees.select_settings(cells(spark), ["price_d1"], first, dt.date(2025, 2, 5), grid=(settings, trees.TreeSettings(rounds=1, leaves=2, least_rows=5)), min_train_days=10)
    assert search.count() == 2 and search.orderBy("mae").first()["place"] in (0, 1) and best.least_rows == 5
    with pytest.raises(ValueError):
        trees.select_settings(cells(spark), ["price_d1"], first, first, grid=())


def test_lags_follow_the_calendar_not_the_row(spark):
    rows = spark.createDataFrame([(dt.date(2025, 1, d), 0, float(d)) for d in (1, 2, 4)], "local_date date, local_hour int, price double")
    found = {r["local_date"].day: r["price_d1"] for r in pit.calendar_lag(rows, "price", 1, "price_d1").collect()}
    assert found == {1: None, 2: 1.0, 4: None}
    many = pit.calendar_lags(rows, {"d1": ("price", 1), "d3": ("price", 3)})
    assert {r["local_date"].day: (r["price"], r["d1"], r["d3"]) for r in many.collect()} == {1: (1.0, None, None), 2: (2.0, 1.0, None), 4: (4.0, None, 1.0)}


def test_similar_day(spark):
    rows = spark.createDataFrame([(dt.date(2025, 1, 6) + dt.timedelta(days=i), 1.0, 7.0) for i in range(7)], "local_date date, price_d1 double, price_d7 double")
    assert [r["price_similar_day"] for r in pit.with_similar_day(rows).orderBy("local_date").collect()] == [7, 1, 1, 1, 1, 7, 7]


def test_only_published_vintages_enter(spark):
    panel = spark.createDataFrame([(dt.date(2025, 1, 10), 5)], "local_date date, local_hour int")
    at = dt.datetime(2025, 1, 10, 4)
    gate = dt.datetime(2025, 1, 9, 11)  # noon in Berlin
    rows = [(at, gate - dt.timedelta(hours=5), 1.0), (at, gate, 2.0), (at, gate + dt.timedelta(minutes=1), 3.0)]
    vintages = spark.createDataFrame(rows, "ts_utc timestamp_ntz, published_at timestamp_ntz, load double")
    found = one(pit.point_in_time(panel, vintages, DE_LU, ("load",)))
    assert found["load"] == 2.0 and found["forecast_age_hours"] == 0


def test_common_sample_rejects_duplicates(spark):
    rows = naive_forecasts(cells(spark, 12))
    assert pit.common_sample(rows).count() == rows.count()
    assert pit.common_sample(rows.where("not (model = 'naive_previous_day' and local_hour = 3)")).where("local_hour = 3").count() == 0
    with pytest.raises(Exception, match="duplicate"):
        pit.common_sample(rows.unionByName(rows)).collect()


def test_quantiles_need_a_full_window_and_exclude_today(spark):
    rows = [("m", dt.date(2025, 1, 1) + dt.timedelta(days=i), 0, 10.0, 10.0 + i) for i in range(6)]
    frame = spark.createDataFrame(rows, "model string, local_date date, local_hour int, forecast double, actual double")
    found = with_quantiles(frame, window=4).orderBy("local_date").collect()
    assert [r["q50"] is None for r in found] == [True] * 4 + [False] * 2
    assert found[4]["q50"] == pytest.approx(11.5) and found[4]["q10"] == pytest.approx(10.3)


def test_negative_goes_before_scarcity(spark):
    rows = spark.createDataFrame([("m", dt.date(2025, 1, 1), h, 0.0, -5.0 + 0.1 * h) for h in range(4)], "model string, local_date date, local_hour int, forecast double, actual double")
    assert {r["regime"] for r in with_regime(rows).collect()} == {"negative"}


def test_coverage_and_pinball_by_hand(spark):
    rows = [(0.0, 0.0, -5.0, 0.0, 5.0), (0.0, 10.0, -5.0, 0.0, 5.0), (0.0, -10.0, -5.0, 0.0, 5.0), (0.0, 0.0, None, None, None)]
    frame = spark.createDataFrame([tuple(map(lambda v: v, r)) for r in rows], "forecast double, actual double, q10 double, q50 double, q90 double")
    found = frame.agg(*metric_columns()).first()
    assert found["interval_coverage_pct"] == pytest.approx(100 / 3) and found["interval_mean_width"] == 10 and found["n_interval"] == 3
    pinball = np.mean([[max(q * g, (q - 1) * g) for g in [a - b]] for q, b in ((0.1, -5), (0.5, 0), (0.9, 5)) for a in (0, 10, -10)])
    assert np.mean([found["pinball_q10"], found["pinball_q50"], found["pinball_q90"]]) == pytest.approx(float(pinball))


def test_scoreboard_skill(spark):
    start = dt.date(2025, 1, 1)
    rows = [(m, start + dt.timedelta(days=i), 10, 100.0 + e, 100.0, None, None, None) for i in range(5) for m, e in (("good", 1.0), ("base", 2.0), ("zero", 0.0))]
    frame = spark.createDataFrame(rows, "model string, local_date date, local_hour int, forecast double, actual double, q10 double, q50 double, q90 double")
    found = {r["model"]: r for r in scoreboard(frame, DE_LU, "base", ["base"]).where("scope = 'overall'").collect()}
    assert found["good"]["skill_pct"] == pytest.approx(50) and found["base"]["skill_pct"] == 0
    with pytest.raises(ValueError):
        scoreboard(frame, DE_LU, "absent")


def test_backtest_runs_end_to_end(spark):
    panel = Panel(DE_LU, cells(spark, 60), ("price_d1", "price_d7", "price_similar_day"))
    result = run(panel, 20, 10, alphas=(0.1, 1.0), min_train_rows=10)
    assert result.test_start == dt.date(2025, 1, 31) and result.predictions.select("model").distinct().count() == 4
    assert result.scores.where("scope = 'overall'").count() == 4
    with pytest.raises(InsufficientHistory):
        run(panel, 50, 10)
    grid = (trees.TreeSettings(rounds=2, leaves=3, least_rows=5),)
    more = run(panel, 20, 10, alphas=(0.1,), min_train_rows=10, trees=True, grid=grid, refit_every_days=30)
    facts = more.metadata()
    assert more.predictions.select("model").distinct().count() == 5 and facts["trees"]["rounds"] == 2 and len(facts["overall"]) == 5 and facts["test_days"] == 30


def test_panel_from_facts(spark):
    from .frames import HOUR, generation, prices, utc

    start, n = utc(2025, 1, 1, 23), 24 * 10
    price = prices(spark, [(start + h * HOUR, h % 24) for h in range(n)])
    load = price.withColumnRenamed("price", "load_mw").withColumn("load_mw", F.lit(100.0))
    wind = generation(spark, [(start + h * HOUR, 10) for h in range(n)], "wind").unionByName(generation(spark, [(start + h * HOUR, 20) for h in range(n)], "solar"))
    panel = build_panel(price, DE_LU, load, wind)
    row = one(panel.complete().where("local_date = date'2025-01-10' and local_hour = 5"))
    assert row["price"] == 5 and row["price_d1"] == 5 and row["residual_d2"] == 70 and row["price_d1_mean"] == 11.5 and row["price_d1_end"] == 23
    assert price_features(panel.frame.select("local_date", "local_hour", "price")).count() == panel.frame.count()
