"""Properties of the analyses and checks against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import backtest as B
from shelfwise.operators import concentration as K
from shelfwise.operators import customers as U
from shelfwise.operators import forecast as M
from shelfwise.operators import inventory as I
from shelfwise.operators import orders as O
from shelfwise.operators import promotions as R
from shelfwise.operators import quality as Q
from shelfwise.operators import recursion as N
from shelfwise.operators import report as V
from shelfwise.sources import catalog, session, sinks
from shelfwise.sources.star import Shop

DAY = dt.date(2018, 1, 1)


def test_decomposition_adds_up(spark):
    rows = [(dt.date(2020, m, 1), 1000.0 * m * m, 10 + m) for m in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "month date, revenue double, orders int")
    for r in O.revenue_decomposition(df).collect():
        assert r.order_effect + r.aov_effect + r.interaction == pytest.approx(r.d_revenue)


def test_shares_and_hhi(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "g string, revenue double")
    ranked = K.ranked_shares(df, "g").orderBy("place").collect()
    assert sum(r.share for r in ranked) == pytest.approx(1.0)
    row = K.concentration(df, "g").first()
    assert 0 < row.hhi <= 1 and row.groups_for_50 == 1 and row.groups_for_80 == 2 and row.groups_for_90 == 3


def test_rolling_concentration_matches_dense_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), DAY + dt.timedelta(days=int(d)), float(v)) for k, d, v in zip(rng.integers(0, 6, 80), rng.integers(0, 50, 80), rng.uniform(1, 9, 80))]
    pdf = pd.DataFrame(rows, columns=["k", "date", "v"]).groupby(["date", "k"]).v.sum().reset_index()
    df = spark.createDataFrame(pdf)
    got = K.rolling_concentration(df.withColumn("date", F.to_date("date")), "k", "v", 10, 3).toPandas().set_index("date")
    span = [pdf.date.min() + dt.timedelta(days=i) for i in range((pdf.date.max() - pdf.date.min()).days + 1)]
    wide = pdf.pivot(index="date", columns="k", values="v").reindex(span).fillna(0)
    rolled = wide.shift(1).rolling(10, min_periods=3).sum()
    for day, row in got.iterrows():
        share = rolled.loc[day] / rolled.loc[day].sum()
        assert row.hhi == pytest.approx((share**2).sum())
        assert row.top_1_share == pytest.approx(share.max())
        assert row.active == (share > 1e-12).sum()


def test_cohorts(spark):
    rows = [(1, "2020-01-05"), (1, "2020-02-01"), (2, "2020-01-20"), (3, "2020-02-03"), (3, "2020-02-28"), (4, "2020-03-01")]
    orders = spark.createDataFrame(rows, "customer_id int, d string").select("customer_id", F.to_date("d").alias("order_date"))
    table = {(str(r.cohort), r.months_since): r.retention for r in U.cohort_retention(orders).collect()}
    assert table == {("2020-01-01", 0): 1.0, ("2020-01-01", 1): 0.5, ("2020-02-01", 0): 1.0, ("2020-03-01", 0): 1.0}
    assert all(0 <= v <= 1 for v in table.values())
    early = spark.createDataFrame([(1, dt.date(2020, 2, 1))], "customer_id int, acquired_on date")
    later = U.cohort_retention(orders.where("customer_id = 1"), early).collect()
    assert [(r.months_since, r.retention) for r in later] == [(0, 1.0)]  # activity before signup is dropped


def test_new_vs_returning_adds_up(spark):
    rows = [(1, "2020-01-05"), (1, "2020-01-05"), (1, "2020-02-01"), (2, "2020-02-20")]
    orders = spark.createDataFrame(rows, "customer_id int, d string").select("customer_id", F.to_date("d").alias("order_date"))
    got = {r.month.month: r for r in U.new_vs_returning(orders).collect()}
    assert (got[1].orders, got[1].repeat_orders, got[1].new_customers) == (2, 1, 1)
    assert (got[2].active_customers, got[2].new_customers, got[2].returning_customers) == (2, 1, 1)


def test_promo_calendar(spark):
    promos = spark.createDataFrame(
        [("A", "percentage", 10.0, DAY, DAY + dt.timedelta(days=1)), ("B", "fixed", 50.0, DAY, DAY)],
        "promo_id string, promo_type string, discount_value double, start_date date, end_date date",
    )
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(3)], "date date")
    got = R.promo_calendar(promos, days).orderBy("date").collect()
    assert [r.active_promos for r in got] == [2, 1, 0]
    assert got[0].promo_ids == "A, B" and got[2].promo_ids == "" and not got[2].has_promo


def test_metrics_are_null_safe(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "a double, p double")
    row = B.forecast_metrics(df, "a", "p").first()
    a, p = np.array([0.0, 2, 4]), np.array([1.0, 1, 5])
    assert row.mae == pytest.approx(1.0) and row.mape == pytest.approx((0.5 + 0.25) / 2 * 100)
    assert row.r2 == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "a double, p double")
    assert B.forecast_metrics(flat, "a", "p").first().r2 is None


def naive_loop(values, steps):
    values = list(values)
    for _ in range(steps):
        back = [values[-k] for k in (364, 365, 366) if k <= len(values)]
        values.append(float(np.mean(back)))
    return values[-steps:]


def test_seasonal_naive_two_blocks(spark):
    rng = np.random.default_rng(2)
    past = rng.uniform(10, 20, 500)
    rows = [(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(past)]
    history = spark.createDataFrame(rows, "date date, revenue double")
    ahead = spark.createDataFrame([(DAY + dt.timedelta(days=500 + i),) for i in range(548)], "date date")
    got = M.seasonal_naive(history, ahead, horizon=548).orderBy("date").toPandas().revenue_naive
    assert np.allclose(got, naive_loop(past, 548))


def test_baseline_uses_one_for_unknown_days(spark):
    rows = [(DAY + dt.timedelta(days=i), 100.0) for i in range(365)]
    history = spark.createDataFrame(rows, "date date, revenue double")
    growth = spark.createDataFrame([(1.1,)], "revenue double")
    leap = spark.createDataFrame([(dt.date(2020, 2, 29),)], "date date")
    value = M.seasonal_baseline(history, leap, growth, ["revenue"]).first().revenue_seasonal_base
    assert value == pytest.approx(100 * 1.1**2)


def test_recursive_forecast_is_complete(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(800):
        orders = 20 + int(5 * np.sin(i / 58) + rng.integers(0, 4))
        rows.append((DAY + dt.timedelta(days=i), orders * 50.0, orders * 30.0, orders))
    sales = spark.createDataFrame(rows, "date date, revenue double, cogs double, orders int")
    history = M.load_history(sales)
    table, growth = N.known_features(history, since=2018)
    models = N.linear_models(N.fit_linear(N.training_rows(table)))
    ahead = spark.createDataFrame([(DAY + dt.timedelta(days=800 + i),) for i in range(30)], "date date")
    bases = N.coming_days(history, ahead, growth)
    got = N.recursive_forecast(history, bases, models, {"blend": (0.5, 0.5)}).orderBy("date").toPandas()
    assert len(got) == 30 and np.isfinite(got.revenue).all() and (got[["revenue", "cogs"]] >= 0).all().all()
    assert got.revenue.mean() == pytest.approx(1000, rel=0.5)
    template = spark.createDataFrame(got[["date"]])
    assert M.template_check(template, "2020-03-11", "2020-04-09").first().valid


@pytest.mark.parametrize("days", [1, 2, 9, 10, 40])
def test_recursion_has_the_features_of_training(spark, days):
    known = [(DAY + dt.timedelta(days=i), None if i % 4 == 3 else 10.0 + i * i % 7) for i in range(days)]
    history = spark.createDataFrame([*known, (DAY + dt.timedelta(days=days), 1.0)], "date date, revenue double")
    names = [f"revenue_roll_{k}_{w}" for k in ("mean", "std") for w in (7, 30, 365)] + ["revenue_lag_1", "revenue_yoy_lag_mean"]
    trained = M.history_features(history, ["revenue"]).orderBy(F.desc("date")).select(*names).first().asDict()
    state = {"revenue": np.array([np.nan if v is None else v for _, v in known])}
    recursed = dict(zip(names, N.day_features(names, state, days, {})))
    want = [np.nan if trained[n] is None else trained[n] for n in names]
    assert np.allclose([recursed[n] for n in names], want, equal_nan=True)


def test_write_forecast_refuses_bad_frames(spark, tmp_path):
    days = [(DAY + dt.timedelta(days=i),) for i in range(3)]
    template = spark.createDataFrame(days, "date date")
    good = template.withColumns({"revenue": F.lit(-1.234), "cogs": F.lit(2.345)})
    row = sinks.write_forecast(good, template, str(tmp_path / "f")).first()
    assert row.rows == 3 and row.negative == 0 and row.cogs_above_revenue == 3
    back = catalog.read_table(spark, str(tmp_path / "f"), "date DATE, revenue DOUBLE, cogs DOUBLE")
    assert {(r.revenue, r.cogs) for r in back.collect()} == {(0.0, 2.35)}
    with pytest.raises(ValueError, match="template"):
        sinks.write_forecast(good.limit(2), template, str(tmp_path / "g"))
    with pytest.raises(ValueError, match="missing"):
        sinks.write_forecast(good.withColumn("cogs", F.lit(None).cast("double")), template, str(tmp_path / "h"))
    with pytest.raises(ValueError, match="template"):
        sinks.write_forecast(good.limit(2), template, str(tmp_path / "f"))
    again = catalog.read_table(spark, str(tmp_path / "f"), "date DATE, revenue DOUBLE, cogs DOUBLE")
    assert again.count() == 3  # what was refused has replaced nothing
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]


def test_cached_stage(spark, tmp_path):
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(3)], "date date")
    calls = []

    def build():
        calls.append(1)
        return days.withColumn("p", F.lit(1.0))

    path = str(tmp_path / "stage")
    states = [sinks.cached_stage(spark, path, build, ["p"], ["date"], days)[1] for _ in range(2)]
    assert states == ["recomputed", "loaded"] and len(calls) == 1
    _, state = sinks.cached_stage(spark, path, build, ["p"], ["date"], days, refresh=True)
    assert state == "recomputed"
    with pytest.raises(ValueError):
        sinks.cached_stage(spark, path, lambda: days.limit(2).withColumn("p", F.lit(1.0)), ["p"], ["date"], days, refresh=True)
    assert spark.read.parquet(path).count() == 3


def test_waterfall(spark):
    df = spark.createDataFrame([(1, "start", 10.0), (2, "up", 5.0), (3, "down", -3.0)], "i int, l string, v double")
    got = [(r.label, r.bottom, r.end_level) for r in V.waterfall(df, "i", "l", "v").orderBy("position").collect()]
    assert got == [("start", 0.0, 10.0), ("up", 10.0, 15.0), ("down", 15.0, 12.0), ("total", 0.0, 12.0)]


def test_published_index_values():
    # Yearly revenue, orders and sessions of two years and their indexes.
    revenue, orders, sessions = (1657169417.27, 1169748831.69), (76849, 36004), (6801940, 11063658)
    index = [round(b / a * 100, 2) for a, b in (revenue, orders, sessions)]
    assert index == [70.59, 46.85, 162.65]
    assert round(orders[0] / sessions[0] * 100, 4) == 1.1298
    assert round(revenue[0] / orders[0], 2) == 21563.97


def test_reconcile_with_itself(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), float(i)) for i in range(5)], "date date, v double")
    row = Q.reconcile_series(df, df, "v").first()
    assert row.correlation == pytest.approx(1.0) and row.total_difference == 0


def test_references_come_from_known_days_only(spark):
    def features(level):
        rows = [
            (DAY + dt.timedelta(days=i), v, v / 2, 3, v / 3, 0.5)
            for i in range(500)
            for v in [100.0 + i % 7 if i < 400 else level]
        ]
        whole = spark.createDataFrame(rows, "date date, revenue double, cogs double, orders long, aov double, cogs_ratio double")
        known = whole.where(F.col("date") < F.lit(DAY + dt.timedelta(days=400)))
        table = M.feature_matrix(whole, M.annual_growth(known), known=known)
        return {r.date: r.revenue_seasonal_base for r in table.select("date", "revenue_seasonal_base").collect()}

    one, other = features(5.0), features(900.0)
    assert len(one) == 500 and one == pytest.approx(other)


def test_metrics_replace_the_file_before(spark, tmp_path):
    for n in (5, 2):
        sinks.write_metrics(spark.range(n), str(tmp_path / "m"), one_file=True)
    assert catalog.read_table(spark, str(tmp_path / "m"), "id LONG").count() == 2
    with pytest.raises(Exception, match="(?i)zero"):
        sinks.write_metrics(spark.range(3).select((1 / F.col("id")).alias("id")), str(tmp_path / "m"))
    assert catalog.read_table(spark, str(tmp_path / "m"), "id LONG").count() == 2


@pytest.mark.parametrize("block", [1, 4, 32])
def test_top_of_steps_equals_every_day_laid_out(spark, block):
    random = np.random.default_rng(8)
    sales = pd.DataFrame({"k": random.integers(0, 12, 300), "day": random.integers(0, 90, 300), "v": random.integers(1, 30, 300).astype(float)})
    sales = sales.groupby(["k", "day"], as_index=False)["v"].sum()
    sales["date"] = [DAY + dt.timedelta(days=int(d)) for d in sales["day"]]
    steps = K.rolling_steps(spark.createDataFrame(sales[["k", "date", "v"]]), "k", "v", 7)
    got = {(r.day, r.place): r.v for r in K.top_of_steps(steps, "k", 3, block).collect()}
    start = (DAY - dt.date(1970, 1, 1)).days
    want = {}
    for day in range(1, 100):
        sums = sales[(sales["day"] >= day - 7) & (sales["day"] < day)].groupby("k")["v"].sum()
        for place, v in enumerate(sorted(sums, reverse=True)[:3], 1):
            want[start + day, place] = v
    assert got == want


def test_quantiles_of_wide_values(spark):
    from shelfwise.functions.ordered import quantiles

    random = np.random.default_rng(6)
    for values in (random.normal(size=500) * 10.0 ** random.integers(-200, 200, 500), np.zeros(9), np.array([-0.0, 0.0, -5e-324, 5e-324]), np.array([-np.inf, 1.0, np.inf]), np.full(50, 3.3)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        row = quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
        order = np.sort(values)
        spot = 0.37 * (len(values) - 1)
        low, high = order[int(np.floor(spot))], order[int(np.ceil(spot))]
        assert row.a == order[0] and row.c == order[-1]
        if np.isfinite([low, high]).all():
            assert np.isclose(row.b, low + (high - low) * (spot - np.floor(spot)), rtol=1e-12, atol=0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_move_sales_once_and_are_worked_out_once(spark):
    rows = [(1, DAY, 5.0), (1, DAY + dt.timedelta(days=30), 2.0), (2, DAY + dt.timedelta(days=9), None), (None, DAY, 1.0)]
    daily = spark.createDataFrame(rows, "k int, date date, v double")
    assert plan_of(K.rolling_steps(daily, "k", "v", 30)).count("Exchange") == 1
    found = K.rolling_concentration(daily, "k", "v", 30, 1)
    assert "ExistingRDD" not in plan_of(found)  # reads the stored steps only
    got = {(r.date - DAY).days: r for r in found.collect()}
    assert sorted(got) == list(range(1, 31))
    assert {d: r.top_value_before for d, r in got.items() if r.top_value_before} == {1: 5.0}
    assert [got[d].active for d in (1, 30)] == [2, 2]
    assert got[30].top_1_share == got[30].top_10_share == pytest.approx(5 / 6)  # rows without a key make no place


def test_stockouts_per_month_without_a_copy_of_rows(spark):
    rows = [(1, "a", True, 2.0, 3, 0.5), (1, "a", True, None, 3, None), (1, "a", False, 4.0, 0, 1.0), (2, "a", None, 1.0, None, 1.0), (None, "a", True, 1.0, 2, 0.0), (3, "b", False, None, None, None)]
    stock = spark.createDataFrame(rows, "product_id int, month string, stockout_flag boolean, stock_on_hand double, stockout_days int, fill_rate double")
    found = I.stockout_monthly(stock)
    assert "Expand" not in plan_of(found)
    got = {r.month: tuple(r)[1:] for r in found.collect()}
    assert got["a"] == (5, 3, 0.6, 1, 2.0, 0.625, 8, 4.0)
    assert got["b"] == (1, 0, 0.0, 0, None, None, None, None)
    products = {r.product_id: (r.records, r.stockout_products, r.days_per_product) for r in I.stockout_monthly(stock, ["product_id"]).collect()}
    assert products == {1: (3, 1, 6.0), 2: (1, 0, None), 3: (1, 0, None), None: (1, 0, None)}


def test_tasks_of_the_shop_are_bounded(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    coarse, fine = spark.newSession(), spark.newSession()
    coarse.conf.set(session.SIZES[0], "128m")
    fine.conf.set(session.SIZES[0], "1m")
    fine.conf.set(name, 5000)
    for one in (coarse, fine):
        Shop(one, str(tmp_path))
        assert all(session.size_bytes(one.conf.get(key)) <= session.TASK_BYTES for key in session.SIZES)
        assert int(one.conf.get(name)) >= session.PARTITIONS
    assert (fine.conf.get(session.SIZES[0]), fine.conf.get(name)) == ("1m", "5000")
    sizes = ("67108864b", "64m", "2 GB", "7")
    assert [session.size_bytes(s) for s in sizes] == [64 << 20, 64 << 20, 2 << 30, 7]
