"""Small frames that pin null, division, bin, rank and window rules."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions.ordered import percent_rank_over
from shelfwise.operators import aggregate as A
from shelfwise.operators import derive as P
from shelfwise.operators import joins as J
from shelfwise.operators import quality as Q
from shelfwise.operators import timeseries as T

DAY = dt.date(2020, 1, 1)


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


def one(df):
    return df.first().asDict()


def test_division_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 1e-12), (6.0, 3.0)], "a double, b double")
    rows = df.select(
        S.ratio(F.col("a"), F.col("b")).alias("r"), S.safe_divide(F.col("a"), F.col("b")).alias("s")
    ).collect()
    assert [r.s for r in rows] == [None, None, None, 2.0]
    assert rows[0].r is None and rows[1].r is None and rows[3].r == 2.0


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("1,234",), ("12%",), ("abc",), ("",)], "t string")
    assert [r[0] for r in df.select(S.parse_number(F.col("t"))).collect()] == [1234.0, 12.0, None, None]


def test_keys(spark):
    raw = [" 12 ", "12.0", "0012", "nan", "None", "", None, "-3.00"]
    df = spark.createDataFrame([(r,) for r in raw], "k string")
    got = [r[0] for r in df.select(S.normalize_key(F.col("k"))).collect()]
    assert got == ["12", "12", "0012", None, None, None, None, "-3"]
    stats = one(Q.key_format_diagnostics(df, ["k"]))
    assert (stats["outer_whitespace"], stats["decimal_like"], stats["leading_zero"], stats["missing"]) == (1, 2, 1, 1)


def test_ratio_repair(spark):
    df = spark.createDataFrame([(0.4,), (45.0,), (-0.2,), (1.5,), (1.6,)], "v double")
    got = [r[0] for r in df.select(S.repair_ratio(F.col("v"))).collect()]
    assert got == pytest.approx([0.4, 0.45, -0.2, 1.5, 0.016])


def test_ranks_match_pandas(spark):
    values = [3.0, 1.0, 3.0, 3.0, None, 2.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", percent_rank_over(F.col("v")).alias("r")).orderBy("i").toPandas().r
    want = pd.Series(values).rank(pct=True)
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_weighted_mean(spark):
    rows = [("a", 1.0, 1.0), ("a", 5.0, 3.0), ("a", 100.0, 0.0), ("a", 100.0, None), ("b", 2.0, 0.0), ("b", 4.0, -1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r.g: r.v for r in A.weighted_means(df, ["g"], ["v"], "w").collect()}
    assert got == {"a": 4.0, "b": 3.0}


def test_skewness_matches_pandas(spark):
    values = [1.0, 2.0, 2.0, 9.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = one(A.skew_raw_and_log(df, "v"))
    assert got["skew"] == pytest.approx(pd.Series(values).skew())
    assert got["log_skew"] == pytest.approx(np.log1p(pd.Series(values)).skew())
    flat = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "v double")
    assert one(A.skew_raw_and_log(flat, "v"))["skew"] is None


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 6, None)], "n int")
    got = [r[0] for r in df.select(S.order_tier(F.col("n"))).collect()]
    assert got == ["one_time"] * 2 + ["2_3_orders"] * 2 + ["4_5_orders"] * 2 + ["6_plus_orders", None]


@pytest.mark.parametrize("n", [1, 2, 7, 23])
def test_equal_count_bins_match_qcut(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("p"), F.lit(n).alias("n"))
    got = df.select("p", S.equal_count_bin(F.col("p"), F.col("n"), 5).alias("b")).orderBy("p").toPandas().b
    if n == 1:
        assert got.tolist() == [1]
    else:
        want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False, duplicates="drop") + 1
        assert got.tolist() == want.tolist()


def test_mode_takes_smallest(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("a", None)], "g string, v string")
    assert one(A.group_mode(df, ["g"], "v"))["mode"] == "x"


def test_correlation_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(A.correlations(df, [("x", "y")]))["correlation"] is None


def test_lookup_join_keeps_rows(spark):
    fact = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    dim = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, name string")
    rows = sorted((r.k, r.name) for r in J.lookup_join(fact, dim, ["k"]).collect() if r.k != 3)
    assert rows == [(1, "a"), (1, "a"), (2, "c")]


def test_origin_and_orphans(spark):
    child = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "k string")
    parent = spark.createDataFrame([("1",), ("2",), ("2",)], "k string")
    check = one(Q.foreign_key_check(child, parent, "k"))
    assert (check["orphan_keys"], check["orphan_rows"], check["null_key_rows"]) == (1, 1, 1)
    assert [r.k for r in Q.orphan_samples(child, parent, "k").collect()] == ["9"]
    quality = one(Q.join_quality(parent, child.where("k IS NOT NULL"), "k"))
    assert (quality["left_matched_rows"], quality["right_unmatched_rows"], quality["left_duplicate_keys"]) == (1, 1, 1)


def test_intervals(spark):
    rows = [("a", DAY, DAY), ("b", DAY, dt.date(2020, 1, 3)), ("c", dt.date(2020, 1, 3), DAY), ("d", None, DAY)]
    df = spark.createDataFrame(rows, "p string, s date, e date")
    got = sorted((r.p, r.date.day) for r in J.expand_intervals(df, "s", "e").collect())
    assert got == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]


def test_near_days_matches_brute_force(spark):
    left = [DAY + dt.timedelta(days=d) for d in (0, 10, 11, 40)]
    right = [DAY + dt.timedelta(days=d) for d in (3, 18, 60)]
    a = spark.createDataFrame([(d,) for d in left], "date date")
    b = spark.createDataFrame([(d,) for d in right], "date date")
    got = sorted(r.date for r in J.near_days(a, b, 7).collect())
    assert got == [x for x in left if any(abs((x - y).days) <= 7 for y in right)]


def test_densify_and_rolling_rules(spark):
    kept = [d for i, d in enumerate(days(10)) if i not in (2, 5, 6)]
    rows = [(d, None if i == 1 else float(i)) for i, d in enumerate(kept)]
    df = spark.createDataFrame(rows, "date date, v double")
    dense = T.densify(df, {})
    pdf = pd.DataFrame(rows, columns=["date", "v"]).set_index("date").reindex(days(10)).v.astype(float)
    got = T.rolling(dense, "v", 4, "mean", 2).orderBy("date").toPandas()
    assert len(got) == 10 and got.was_observed.sum() == 7
    assert np.allclose(got.v_roll_mean_4.astype(float), pdf.rolling(4, min_periods=2).mean(), equal_nan=True)
    shifted = T.rolling(dense, "v", 4, "std", 2, shift=1).orderBy("date").toPandas()
    want = pdf.shift(1).rolling(4, min_periods=2).std()
    assert np.allclose(shifted.v_roll_std_4.astype(float), want, equal_nan=True)
    again = T.densify(dense.drop("was_observed"), {})
    assert again.count() == 10 and again.where("was_observed").count() == 10


def test_leak_safety(spark):
    base = [(d, float(i % 7 + i)) for i, d in enumerate(days(60))]
    changed = [(d, v if i < 40 else v * 100) for i, (d, v) in enumerate(base)]
    spec = [("v", "lag", 1), ("v", "lag", 7), ("v", "mean", 7, 3, 1), ("v", "std", 30, 10, 1)]

    def features(rows):
        df = T.feature_columns(spark.createDataFrame(rows, "date date, v double"), spec)
        return df.where(F.col("date") <= days(60)[40]).drop("v").orderBy("date").collect()

    assert features(base) == features(changed)


def test_fill_from_past_then_future(spark):
    rows = [(days(4)[0], 0.0, 0, 1.0), (days(4)[1], 10.0, 2, 5.0), (days(4)[2], 0.0, 0, 0.0), (days(4)[3], 9.0, 3, 3.0)]
    df = spark.createDataFrame(rows, "date date, revenue double, orders int, cogs double")
    got = [r.aov for r in P.aov_and_cost_ratio(df).orderBy("date").collect()]
    assert got == [5.0, 5.0, 5.0, 3.0]


def test_flag_periods(spark):
    flags = [True, True, False, True, False, True, True, True]
    df = spark.createDataFrame([(d, f, 1.0) for d, f in zip(days(8), flags)], "date date, f boolean, v double")
    got = sorted((r.start_date.day, r.days) for r in T.flag_periods(df, "f", "v").collect())
    assert got == [(1, 2), (4, 1), (6, 3)]


def test_spaced_top(spark):
    offsets = [0, 30, 95, 100, 200, 210]
    scores = [5.0, 9.0, 8.0, 1.0, 2.0, 7.0]
    df = spark.createDataFrame([(DAY + dt.timedelta(days=o), s) for o, s in zip(offsets, scores)], "date date, s double")
    got = sorted((r.date - DAY).days for r in T.spaced_top(df, "s", 90, 12).collect())
    chosen = []
    for s, o in sorted(zip(scores, offsets), reverse=True):
        if all(abs(o - c) >= 90 for c in chosen):
            chosen.append(o)
    assert got == sorted(chosen)


@pytest.mark.parametrize("shape", ["random", "rising", "flat"])
def test_spaced_top_is_greedy_on_long_series(spark, shape):
    rng = np.random.default_rng(11)
    n, gap, most = 4000, 20, 7
    score = {"random": rng.integers(0, 50, n), "rising": np.arange(n), "flat": np.zeros(n)}[shape].astype(float)
    rows = [(s, DAY + dt.timedelta(days=i), float(v)) for s, sign in (("up", 1), ("down", -1), (None, 1)) for i, v in enumerate(sign * score)]
    rows += [("up", DAY, None), ("up", DAY, float("nan")), ("up", DAY, -1.0), ("blank", DAY, None)]
    found = T.spaced_top(spark.createDataFrame(rows, "k string, date date, s double").repartition(5), "s", gap, most, ["k"]).collect()
    for k, sign in (("up", 1), ("down", -1), (None, 1)):
        chosen = []
        for i in sorted(range(n), key=lambda i: (-sign * score[i], i)):
            if len(chosen) < most and all(abs(i - c) >= gap for c in chosen):
                chosen.append(i)
        assert sorted((r.date - DAY).days for r in found if r.k == k) == sorted(chosen)
    assert not [r for r in found if r.k == "blank"]


def test_spaced_top_without_spacing_or_rows(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=o), float(o % 3)) for o in range(9)], "date date, s double")
    assert sorted((r.date - DAY).days for r in T.spaced_top(df, "s", 0, 4).collect()) == [1, 2, 5, 8]
    assert T.spaced_top(df.where("s < 0"), "s").count() == 0


def test_rolling_correlation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([(d, float(a), float(b)) for d, a, b in zip(days(40), x, y)], "date date, x double, y double")
    got = T.rolling_correlation(df, "x", "y", 10, 5, lag=2).orderBy("date").toPandas().rolling_corr
    want = pd.Series(x).rolling(10, min_periods=5).corr(pd.Series(y).shift(2))
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_partial_autocorrelation(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(200)
    for i in range(1, 200):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    df = spark.createDataFrame([(d, float(v)) for d, v in zip(days(200), x)], "date date, v double")
    got = T.partial_autocorrelation(df, "v", 4).toPandas().set_index("lag").partial_correlation
    s = pd.Series(x)
    assert got[1] == pytest.approx(s.corr(s.shift(1)))
    assert abs(got[1]) > 0.6 and got[2:].abs().max() < 0.25


def test_gap_summary_counts_same_day_events(spark):
    rows = [(1, DAY), (1, DAY), (1, days(4)[3]), (2, DAY), (2, days(2)[1])]
    df = spark.createDataFrame(rows, "c int, d date")
    got = one(T.gap_summary(df, "c", "d"))
    assert (got["gaps"], got["median_gap"], got["longest_gap"]) == (3, 1.0, 3)
    assert got["mean_gap"] == pytest.approx(4 / 3)


def test_calendar_codes(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),)], "date date")
    row = one(df.select(*[e.alias(n) for n, e in S.calendar_parts(F.col("date")).items()]))
    assert row["weekday"] == 3 and row["week"] == 9 and row["is_month_end"] and row["day_of_year"] == 60
    cyc = one(df.select(*[e.alias(n) for n, e in S.cyclic_parts(F.col("date")).items()]))
    assert cyc["month_sin"] == pytest.approx(math.sin(2 * math.pi * 2 / 12))


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, t string")
    assert one(Q.duplicate_rows(df))["duplicates"] == 1
    table = {r.column: (r.missing, r.mostly_missing) for r in Q.missing_summary(df, 30).collect()}
    assert table == {"i": (0, False), "t": (1, True)}
