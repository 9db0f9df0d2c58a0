"""Models fitted in one pass, flattened trees and recursive forecasts against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import aggregate as A
from shelfwise.operators import forecast as M
from shelfwise.operators import recursion as R
from shelfwise.operators.timeseries import partial_autocorrelation


@pytest.fixture(scope="module")
def days():
    dates = pd.date_range("2012-01-01", "2014-12-31")
    random = np.random.default_rng(3)
    parts = []
    for shop, level in (("a", 900.0), ("b", 40.0)):
        wave = 1 + 0.3 * np.sin(np.arange(len(dates)) * 2 * np.pi / 365.25)
        orders = np.maximum(random.poisson(20 * wave), 1)
        revenue = orders * level * random.uniform(0.8, 1.2, len(dates))
        parts.append(pd.DataFrame({"shop": shop, "date": dates.date, "revenue": revenue, "cogs": revenue * 0.6, "orders": orders}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def history(spark, days):
    return M.load_history(spark.createDataFrame(days), ["shop"]).cache()


def test_one_pass_gives_the_models_of_single_fits(spark):
    random = np.random.default_rng(1)
    frame = pd.DataFrame({"k": random.integers(0, 3, 900), "date": pd.Timestamp("2020-01-01").date()})
    x = random.lognormal(size=(900, 3)) * [1, 50, 0] + [0, 0, 7]
    frame["a"], frame["b"], frame["c"] = x.T
    frame["t"] = np.exp(0.3 * np.log1p(frame["a"]) - 0.2 * np.log1p(frame["b"]) + 0.01 * random.normal(size=900))
    lists = {"t": ["a", "b", "c"]}
    rows = R.training_rows(spark.createDataFrame(frame), ["k"], lists)
    fitted = R.fit_linear(rows, ["k"])
    for row in fitted.collect():
        part = frame[frame["k"] == row.k]
        logs, y = np.log1p(part[["a", "b"]].to_numpy()), np.log1p(part["t"].to_numpy())
        z = (logs - logs.mean(0)) / logs.std(0)
        w = np.linalg.solve(z.T @ z / len(z) + R.PENALTY * np.eye(2), z.T @ ((y - y.mean()) / y.std()) / len(z))
        assert np.allclose(row.weights, [*(w * y.std() / logs.std(0)), 0.0])
        assert np.isclose(row.intercept, y.mean() - logs.mean(0) @ (w * y.std() / logs.std(0)))
        assert row.n == len(part)
    checks = R.gradients(rows, fitted, ["k"]).collect()
    assert len(checks) == 3 and all(c.residual < 1e-9 and c.gradient < 1e-9 for c in checks)


def test_sums_of_products(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0]), (2, [1.0, 0.0, 1.0])], "k int, v array<double>")
    found = A.gram(rows, ["k"], F.col("v")).where("k = 1").toPandas()
    v = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
    assert np.allclose(A.square(found["place"].to_numpy(), found["total"].to_numpy()), v.T @ v)


def test_trees_on_unseen_days(spark, history):
    rows = history.where("shop = 'a'").drop("shop")
    known = M.until(rows, "2014-06-30")
    table = M.feature_matrix(rows, M.annual_growth(known, since=2012), "revenue", known=known).cache()
    seen = F.col("date") <= F.lit("2014-06-30").cast("date")
    names = M.FEATURES["revenue"]
    model = M.fit_gbt(table.where(seen), names, maxIter=10, maxDepth=3)
    found = M.predict(model, table.where(~seen), names).toPandas()
    assert len(found) == found["date"].nunique() == 184
    assert (found["predicted"] >= 0).all()
    mean = table.where(seen).agg(F.avg("target")).first()[0]
    assert (found["predicted"] - found["target"]).abs().mean() < (mean - found["target"]).abs().mean()
    again = M.predict(M.fit_gbt(table.where(seen), names, maxIter=10, maxDepth=3), table.where(~seen), names).toPandas()
    assert np.allclose(found.sort_values("date")["predicted"], again.sort_values("date")["predicted"])


def test_feature_importance(spark):
    random = np.random.default_rng(2)
    frame = pd.DataFrame({"useful": random.uniform(1, 9, 600), "noise": random.uniform(1, 9, 600), "still": 4.0})
    frame["target"] = frame["useful"] ** 2
    rows = spark.createDataFrame(frame)
    names = ["noise", "still", "useful"]
    model = M.fit_gbt(rows, names, maxIter=5, maxDepth=3)
    found = M.feature_importance(model, names, spark).toPandas()
    assert found["feature"][0] == "useful" and set(found["feature"]) == set(names)
    assert found["importance"].is_monotonic_decreasing and np.isclose(found["importance"].sum(), 1)
    assert found.set_index("feature")["importance"]["still"] == 0
    assert len(M.feature_importance(model, names, spark, n=2).collect()) == 2


def test_flat_trees_predict_what_spark_predicts(spark, history):
    features, _ = R.known_features(history.where("shop = 'a'"), ["shop"])
    columns = M.FEATURES["revenue"]
    rows = features.withColumn("target", F.col("revenue")).cache()
    model = M.fit_gbt(rows, columns, maxIter=8)
    flat = R.flat_trees(model, columns)
    scored = M.predict(model, rows, columns).select("date", "predicted").toPandas().set_index("date")["predicted"]
    table = rows.select("date", *columns).toPandas().set_index("date").astype(float)
    got = pd.Series({d: flat.value(r.to_numpy()) for d, r in table.iterrows()})
    assert np.allclose(got.sort_index(), scored.sort_index())


def test_features_of_a_day_are_those_of_the_history(spark, history):
    features, _ = R.known_features(history, ["shop"])
    names = [c for c in features.columns if "_lag_" in c or "_roll_" in c]
    table = features.where("shop = 'b'").toPandas().sort_values("date").reset_index(drop=True)
    state = {c: table[c].to_numpy(float) for c in M.SERIES}
    for size in (0, 1, 5, 364, 365, 366, 800):
        got = R.day_features(names, state, size, {})
        assert np.allclose(got, table.loc[size, names].to_numpy(float), equal_nan=True)


def test_recursion_feeds_on_itself(spark, history):
    known = history.where("date < '2014-12-01'")
    ahead = history.where("date >= '2014-12-01'")
    features, growth = R.known_features(known, ["shop"])
    fitted = R.linear_models(R.fit_linear(R.training_rows(features, ["shop"]), ["shop"]), ["shop"])
    bases = R.coming_days(known, ahead, growth, ["shop"])
    weights = {"direct": (1.0, 1.0), "mixed": (0.4, 0.7)}
    got = R.recursive_forecast(known, bases, fitted, weights, ["shop"]).toPandas()
    assert len(got) == 2 * 2 * 31
    future = bases.toPandas()
    for shop in "ab":
        past = known.where(F.col("shop") == shop).toPandas().sort_values("date")
        for variant, (r, c) in weights.items():
            state = {s: past[s].astype(float).tolist() for s in M.SERIES}
            own = got[(got["series"] == shop) & (got["variant"] == variant)].sort_values("date")
            for day, row in zip(own.to_dict("records"), future[future["shop"] == shop].sort_values("date").to_dict("records")):
                p = {}
                for name, model in fitted[shop].items():
                    x = R.day_features(model.columns, {k: np.array(v) for k, v in state.items()}, len(state["revenue"]), row)
                    p[name] = model.value(x)
                revenue = r * p["revenue"] + (1 - r) * p["orders"] * p["aov"]
                cogs = c * p["cogs"] + (1 - c) * revenue * p["cogs_ratio"]
                assert np.isclose(day["revenue"], revenue) and np.isclose(day["cogs"], cogs)
                for name, value in zip(M.SERIES, (revenue, cogs, p["orders"], revenue / p["orders"], cogs / revenue)):
                    state[name].append(value)


def test_models_without_data(spark, history):
    rows = R.training_rows(R.known_features(history, ["shop"])[0], ["shop"]).limit(0)
    assert R.fit_linear(rows, ["shop"]).count() == 0
    flat = R.training_rows(spark.createDataFrame([("x", None, 1.0, 2.0)], "shop string, date date, f double, t double"), ["shop"], {"t": ["f"]})
    row = R.fit_linear(flat, ["shop"]).first()
    assert row.weights == [0.0] and np.isclose(row.intercept, np.log1p(2.0))


def plain_partial(x, lag, least=20):
    table = np.column_stack([x[lag - k : len(x) - k] for k in range(lag + 1)])
    table = table[~np.isnan(table).any(axis=1)]
    if len(table) < max(least, lag + 5):
        return None, len(table)
    controls = np.column_stack([np.ones(len(table)), table[:, 1:lag]])
    ends = table[:, [0, lag]]
    rest = ends - controls @ np.linalg.lstsq(controls, ends, rcond=None)[0]
    if rest.std(axis=0, ddof=1).min() <= 1e-9:
        return None, len(table)
    return float(np.corrcoef(rest.T)[0, 1]), len(table)


def test_partial_autocorrelation_from_sums(spark):
    random = np.random.default_rng(4)
    walk = np.cumsum(random.normal(size=300)) * 1e4 + 1e6
    holes = np.where(random.random(300) < 0.05, np.nan, walk)
    cases = {"walk": walk, "holes": holes, "flat": np.full(300, 7.0), "short": walk[:24], "one": walk[:1]}
    dates = pd.date_range("2020-01-01", periods=300).date
    rows = [(k, d, None if np.isnan(v) else float(v)) for k, x in cases.items() for d, v in zip(dates, x)]
    df = spark.createDataFrame(rows, "s string, date date, v double")
    got = {(r.series, r.lag): r for r in partial_autocorrelation(df, "v", 15, "s").collect()}
    for name, x in cases.items():
        steps = range(1, min(15, len(x) - 2) + 1)
        assert {lag for k, lag in got if k == name} == {*steps}
        for lag in steps:
            want, pairs = plain_partial(x, lag)
            row = got[name, lag]
            assert row.pairs == pairs
            assert (row.partial_correlation is None) if want is None else np.isclose(row.partial_correlation, want, atol=1e-7)


def test_sums_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, [1.0, 2.0]), ("x", [1.0, 1.0]), (None, [1.0, 3.0])], "k string, v array<double>")
    got = {(r.k, r.place): r.total for r in A.gram(rows, ["k"], F.col("v")).collect()}
    assert got == {(None, 0): 2.0, (None, 1): 5.0, (None, 2): 13.0, ("x", 0): 1.0, ("x", 1): 1.0, ("x", 2): 1.0}
    whole = {r.place: r.total for r in A.gram(rows, [], F.col("v")).collect()}
    assert whole == {0: 3.0, 1: 6.0, 2: 14.0}
