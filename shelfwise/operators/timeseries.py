"""Daily and monthly series: densify, lags, rolling windows, runs and correlograms.

Every window here runs over rows that were aggregated to one per day or month
(and series), so a window partition is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.scalars import (
    at_least,
    at_most,
    change,
    correlation_label,
    ratio,
)
from shelfwise.operators.aggregate import gram, safe_corr, square
from shelfwise.sources.session import checkpointed


def by_date(series: Sequence[str] = (), date: str = "date") -> Window:
    """Calendar order within each series."""
    return Window.partitionBy(*series).orderBy(date)


def daily_series(df: DataFrame, date: str, aggs: Mapping[str, Column], series: Sequence[str] = ()) -> DataFrame:
    """Aggregates per calendar day (and series)."""
    return df.groupBy(*series, F.to_date(date).alias("date")).agg(
        *[e.alias(n) for n, e in aggs.items()]
    )


def densify(daily: DataFrame, fill: Mapping[str, float | None], series: Sequence[str] = (), step: str = "day", date: str = "date") -> DataFrame:
    """Every day (or month) from the first to the last of a series, gaps filled."""
    ends = daily.groupBy(*series).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = ends.select(
        *series, F.explode(F.sequence("_a", "_b", F.expr(f"interval 1 {step}"))).alias(date)
    )
    joined = days.join(daily.withColumn("was_observed", F.lit(True)), [*series, date], "left")
    filled = {n: F.coalesce(n, F.lit(v)) for n, v in fill.items() if v is not None}
    return joined.withColumns(
        {**filled, "was_observed": F.coalesce("was_observed", F.lit(False))}
    )


def resample(daily: DataFrame, grain: str, aggs: Mapping[str, Column], series: Sequence[str] = ()) -> DataFrame:
    """Roll a daily series up to months, quarters or years."""
    return daily.groupBy(*series, F.to_date(F.date_trunc(grain, "date")).alias("period")).agg(
        *[e.alias(n) for n, e in aggs.items()]
    )


# --- lags and rolling windows ---------------------------------------------------

def lags(df: DataFrame, columns: Sequence[str], steps: Sequence[int], series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Lag columns of a dense series, named ``<column>_lag_<k>``."""
    window = by_date(series, date)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(window) for c in columns for k in steps})


def leads(df: DataFrame, columns: Sequence[str], steps: Sequence[int], series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Lead columns of a dense series, named ``<column>_lead_<k>``."""
    window = by_date(series, date)
    return df.withColumns({f"{c}_lead_{k}": F.lead(c, k).over(window) for c in columns for k in steps})


def mean_of(*values: Column) -> Column:
    """Mean of the values that are present."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    known = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return ratio(total, known)


def yoy_lag_mean(df: DataFrame, column: str, series: Sequence[str] = ()) -> DataFrame:
    """Mean of the values 364, 365 and 366 days earlier."""
    window = by_date(series)
    return df.withColumn(
        f"{column}_yoy_lag_mean", mean_of(*[F.lag(column, k).over(window) for k in (364, 365, 366)])
    )


AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}


def rolled(column: str, window: int, agg: str, min_periods: int, shift: int = 0, series: Sequence[str] = (), date: str = "date") -> Column:
    """Trailing window of ``window`` rows ending ``shift`` rows back.

    Null until ``min_periods`` values are present, as the deviation of a single value.
    """
    frame = by_date(series, date).rowsBetween(-(window + shift - 1), -shift)
    return F.when(
        F.count(column).over(frame) >= min_periods, AGGREGATES[agg](column).over(frame)
    )


def rolling(df: DataFrame, column: str, window: int, agg: str = "mean", min_periods: int = 1, shift: int = 0, series: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Add one rolling column; ``shift=1`` keeps the current row out of its own window."""
    return df.withColumn(
        name or f"{column}_roll_{agg}_{window}",
        rolled(column, window, agg, min_periods, shift, series),
    )


def feature_columns(df: DataFrame, spec: Sequence[tuple], series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Lag and rolling columns from one table of specifications.

    Rows read ``(column, "lag", k)`` or ``(column, agg, window, min_periods, shift)``.
    """
    window, out = by_date(series, date), {}
    for column, kind, size, *rest in spec:
        if kind == "lag":
            out[f"{column}_lag_{size}"] = F.lag(column, size).over(window)
        else:
            min_periods, shift = rest
            out[f"{column}_roll_{kind}_{size}"] = rolled(
                column, size, kind, min_periods, shift, series, date
            )
    return df.withColumns(out)


def centered_mean(df: DataFrame, column: str, reach: int = 1, series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Mean of the full neighbourhood and the distance from it."""
    frame = by_date(series, date).rowsBetween(-reach, reach)
    full = F.count(column).over(frame) >= 2 * reach + 1
    return df.withColumn(
        f"{column}_centered", F.when(full, F.avg(column).over(frame))
    ).withColumn(f"{column}_deviation", F.col(column) - F.col(f"{column}_centered"))


def top_deviations(df: DataFrame, column: str, window: int, min_periods: int, n: int = 15) -> DataFrame:
    """Days farthest from their trailing mean."""
    mean = rolled(column, window, "mean", min_periods)
    return (
        df.withColumn("rolling_mean", mean)
        .withColumn("deviation", F.col(column) - F.col("rolling_mean"))
        .where("deviation IS NOT NULL")
        .orderBy(F.abs("deviation").desc(), "date")
        .limit(n)
    )


def rolling_correlation(df: DataFrame, x: str, y: str, window: int, min_periods: int, lag: int = 0, series: Sequence[str] = ()) -> DataFrame:
    """Correlation of ``x`` with ``y`` ``lag`` days earlier over a trailing window."""
    moved = df.withColumn("_y", F.lag(y, lag).over(by_date(series)) if lag else F.col(y))
    frame = by_date(series).rowsBetween(-window + 1, 0)
    both = F.when(F.col(x).isNotNull() & F.col("_y").isNotNull(), 1)
    known = F.count(both).over(frame) >= min_periods
    value = safe_corr(F.col(x), F.col("_y"), lambda c: c.over(frame))
    return moved.withColumn("rolling_corr", F.when(known, value)).drop("_y")


def volatility_regimes(df: DataFrame, column: str, window: int = 30, min_periods: int = 15) -> DataFrame:
    """Leak-safe rolling deviation and variation with top and bottom decile flags."""
    base = df.withColumns(
        {
            "roll_std": rolled(column, window, "std", min_periods, 1),
            "roll_mean": rolled(column, window, "mean", min_periods, 1),
        }
    ).withColumn("roll_cv", ratio(F.col("roll_std"), F.abs("roll_mean")))
    cuts = base.agg(
        F.percentile("roll_std", F.lit(0.9)).alias("std_high"),
        F.percentile("roll_std", F.lit(0.1)).alias("std_low"),
        F.percentile("roll_cv", F.lit(0.9)).alias("cv_high"),
        F.percentile("roll_cv", F.lit(0.1)).alias("cv_low"),
    ).select(F.struct("*")).scalar()
    return base.withColumn("_c", cuts).withColumns(
        {
            "high_volatility": F.coalesce(at_least(F.col("roll_std"), F.col("_c.std_high")), F.lit(False)),
            "low_volatility": F.coalesce(at_most(F.col("roll_std"), F.col("_c.std_low")), F.lit(False)),
            "high_cv": F.coalesce(at_least(F.col("roll_cv"), F.col("_c.cv_high")), F.lit(False)),
            "low_cv": F.coalesce(at_most(F.col("roll_cv"), F.col("_c.cv_low")), F.lit(False)),
        }
    ).drop("_c")


def trend_signals(df: DataFrame, column: str, min_periods: Mapping[int, int]) -> DataFrame:
    """Short against medium and medium against long trailing means, with labels."""
    base = df.withColumns(
        {f"m{w}": rolled(column, w, "mean", m, 1) for w, m in min_periods.items()}
    )
    short, medium, long = sorted(min_periods)
    base = base.withColumns(
        {
            "short_vs_medium": F.col(f"m{short}") - F.col(f"m{medium}"),
            "medium_vs_long": F.col(f"m{medium}") - F.col(f"m{long}"),
        }
    ).where("short_vs_medium IS NOT NULL AND medium_vs_long IS NOT NULL")
    cuts = base.agg(
        F.percentile("short_vs_medium", F.lit(0.75)).alias("up"),
        F.percentile("short_vs_medium", F.lit(0.25)).alias("down"),
    ).select(F.struct("*")).scalar()

    def label(value: str, above: str, below: str) -> Column:
        return F.when(F.col(value) > 0, above).when(F.col(value) < 0, below).otherwise("flat")

    mean = F.col(f"m{medium}")
    return base.withColumn("_c", cuts).withColumns(
        {
            "short_term_direction": label(
                "short_vs_medium", "short_term_above_medium_term", "short_term_below_medium_term"
            ),
            "medium_term_direction": label(
                "medium_vs_long", "medium_term_above_long_term", "medium_term_below_long_term"
            ),
            "pct_vs_medium": F.when(
                F.abs(mean) >= 1e-9, (F.col(column) - mean) / F.abs(mean) * 100
            ),
            "strong_up": at_least(F.col("short_vs_medium"), F.col("_c.up")),
            "strong_down": at_most(F.col("short_vs_medium"), F.col("_c.down")),
        }
    ).drop("_c")


def compare_windows(df: DataFrame, column: str, min_periods: Mapping[int, int]) -> DataFrame:
    """How well each leak-safe trailing mean follows the series, with a combined rank."""
    order = by_date()
    base = df.withColumns(
        {str(w): rolled(column, w, "mean", m, 1) for w, m in min_periods.items()}
    ).withColumn("_change", F.abs(F.col(column) - F.lag(column).over(order)))
    long = base.unpivot(["date", column, "_change"], [str(w) for w in min_periods], "window", "mean")
    step = F.abs(F.col("mean") - F.lag("mean").over(by_date(["window"])))
    error = F.col(column) - F.col("mean")
    table = (
        long.withColumn("step", step)
        .groupBy(F.col("window").cast("int").alias("window_days"))
        .agg(
            F.count(error).alias("valid_days"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            safe_corr(F.col(column), F.col("mean")).alias("correlation"),
            F.avg("step").alias("mean_step"),
            F.avg("_change").alias("_revenue_step"),
        )
        .withColumn("smoothness", ratio(F.col("mean_step"), F.col("_revenue_step")))
    )
    rank = lambda order: F.rank().over(Window.orderBy(order))
    return table.drop("_revenue_step").withColumn(
        "combined_rank",
        rank(F.col("mae"))
        + rank(F.col("correlation").desc())
        + 0.5 * rank(F.col("smoothness")),
    )


# --- runs -----------------------------------------------------------------------

def flag_periods(df: DataFrame, flag: str, value: str, series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Stretches of consecutive flagged days with their length and value range."""
    place = F.row_number().over(by_date(series, date))
    return (
        df.where(F.coalesce(flag, F.lit(False)))
        .withColumn("_island", F.date_sub(date, place))
        .groupBy(*series, "_island")
        .agg(
            F.min(date).alias("start_date"),
            F.max(date).alias("end_date"),
            F.count("*").alias("days"),
            F.max(value).alias("max_value"),
            F.min(value).alias("min_value"),
            F.avg(value).alias("mean_value"),
        )
        .drop("_island")
    )


def direction_runs(monthly: DataFrame, value: str, n: int = 15, date: str = "month") -> DataFrame:
    """Longest stretches of months that only rise or only fall."""
    step = F.col(value) - F.lag(value).over(by_date((), date))
    signs = monthly.withColumn("_step", step).where("_step IS NOT NULL").withColumn(
        "direction",
        F.when(F.col("_step") > 0, "growth").when(F.col("_step") < 0, "decline").otherwise("flat"),
    )
    island = F.row_number().over(by_date((), date)) - F.row_number().over(by_date(["direction"], date))
    return (
        signs.withColumn("_island", island)
        .where("direction <> 'flat'")
        .groupBy("direction", "_island")
        .agg(
            F.min(date).alias("start_month"),
            F.max(date).alias("end_month"),
            F.count("*").alias("length_months"),
            F.sum("_step").alias("total_change"),
        )
        .drop("_island")
        .orderBy(F.desc("length_months"), F.desc("total_change"), "start_month")
        .limit(n)
    )


# --- changes --------------------------------------------------------------------

def period_change(df: DataFrame, value: str, date: str = "period", series: Sequence[str] = (), guard: bool = False) -> DataFrame:
    """Absolute and percentage change from the period before.

    With ``guard`` the percentage needs a base above max(1, a tenth of P5).
    """
    before = F.lag(value).over(by_date(series, date))
    out = df.withColumn("_before", before).withColumn("abs_change", F.col(value) - F.col("_before"))
    if not guard:
        return out.withColumn("pct_change", change(F.col(value), F.col("_before")) * 100).drop("_before")
    floor = df.agg(
        F.greatest(F.lit(1.0), F.percentile(value, F.lit(0.05)) * 0.1).alias("floor")
    ).scalar()
    return (
        out.withColumn("_floor", floor)
        .withColumn(
            "pct_change",
            F.when(
                F.abs("_before") > F.col("_floor"), F.col("abs_change") / F.col("_before") * 100
            ),
        )
        .drop("_before", "_floor")
    )


def top_changes(changes: DataFrame, n: int, date: str = "period") -> DataFrame:
    """Largest rises and falls."""
    known = changes.where("abs_change IS NOT NULL")
    up = known.orderBy(F.desc("abs_change"), date).limit(n).withColumn("side", F.lit("increase"))
    down = known.orderBy("abs_change", date).limit(n).withColumn("side", F.lit("decrease"))
    return up.unionByName(down)


def rank_in_period(df: DataFrame, value: str, period: Sequence[str]) -> DataFrame:
    """Rank from the top and from the bottom within each period."""
    group = Window.partitionBy(*period)
    return df.withColumns(
        {
            "rank_high": F.rank().over(group.orderBy(F.desc(value))),
            "rank_low": F.rank().over(group.orderBy(value)),
        }
    )


def expanding_mean(df: DataFrame, value: str, keys: Sequence[str], min_count: int = 1, date: str = "date") -> DataFrame:
    """Mean of all earlier values with the same key."""
    frame = by_date(keys, date).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(
        f"{value}_history",
        F.when(F.count(value).over(frame) >= min_count, F.avg(value).over(frame)),
    )


def with_group_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Group quantiles on every row of a bounded frame."""
    cuts = df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    return df.join(cuts, list(keys), "left")


def trend_direction(df: DataFrame, value: str, series: Sequence[str] = (), edge: int = 30, least: int = 60) -> DataFrame:
    """First against last ``edge`` values: increasing, decreasing or stable, with slope."""
    first = F.row_number().over(by_date(series))
    last = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc("date")))
    placed = df.where(F.col(value).isNotNull()).withColumns({"_i": first, "_j": last})
    stats = placed.groupBy(*series).agg(
        F.count("*").alias("days"),
        F.avg(F.when(F.col("_i") <= edge, F.col(value))).alias("first_mean"),
        F.avg(F.when(F.col("_j") <= edge, F.col(value))).alias("last_mean"),
        F.regr_slope(value, (F.col("_i") - 1).cast("double")).alias("slope"),
    )
    moved = change(F.col("last_mean"), F.col("first_mean"))
    return stats.withColumn("pct_change", moved).withColumns(
        {
            "direction": F.when(F.col("days") < least, "insufficient data")
            .when(F.col("pct_change").isNull() | (F.abs("pct_change") < 0.05), "stable")
            .when(F.col("pct_change") > 0, "increasing")
            .otherwise("decreasing"),
        }
    )


def index_to_base(df: DataFrame, values: Sequence[str], period: str, base: int) -> DataFrame:
    """Each value as an index with the base period at 100."""
    first = df.where(F.col(period) == base).agg(*[F.max(v).alias(v) for v in values])
    return df.withColumn("_b", first.select(F.struct(*values)).scalar()).withColumns(
        {f"{v}_index": ratio(F.col(v) * 100.0, F.col(f"_b.{v}")) for v in values}
    ).drop("_b")


def change_between(df: DataFrame, values: Sequence[str], period: str, start: int, end: int) -> DataFrame:
    """Relative change of each value between two named periods."""
    at = lambda v, p: F.max(F.when(F.col(period) == p, F.col(v)))
    row = df.agg(*[change(at(v, end), at(v, start)).alias(v) for v in values])
    return row.unpivot([], list(values), "metric", "change")


def growth_volatility(monthly: DataFrame, value: str, series: Sequence[str], date: str = "month") -> DataFrame:
    """Mean and deviation of month-on-month growth per series."""
    moved = monthly.withColumn(
        "growth", change(F.col(value), F.lag(value).over(by_date(series, date)))
    )
    return moved.groupBy(*series).agg(
        F.count("*").alias("months"),
        F.avg("growth").alias("growth_mean"),
        F.stddev_samp("growth").alias("growth_std"),
    )


def growth_profile(monthly: DataFrame, series: str, value: str = "revenue", recent: int = 6) -> DataFrame:
    """First and last month, recent against earlier mean, compound growth, variation.

    ``monthly`` holds one row per series and month; absent months count as zero up
    to the last month of the whole table.
    """
    span = monthly.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.struct("a", "b")
    ).scalar()
    months = monthly.select(series).distinct().withColumn("_s", span).select(
        series,
        F.explode(F.sequence("_s.a", "_s.b", F.expr("interval 1 month"))).alias("month"),
        F.col("_s.b").alias("last_month"),
    )
    v = F.col(value)
    dense = months.join(monthly.select(series, "month", value), [series, "month"], "left").withColumn(
        value, F.coalesce(v, F.lit(0.0))
    )
    is_recent = F.col("month") > F.add_months("last_month", -recent)
    stats = dense.groupBy(series).agg(
        F.sum(v).alias("total"),
        F.count_if(v > 0).alias("observed_months"),
        F.min(F.when(v > 0, F.struct("month", value))).alias("first"),
        F.max(F.struct("month", value)).alias("last"),
        F.percentile(F.when(v > 0, v), F.lit(0.5)).alias("typical"),
        F.avg(F.when(is_recent, v)).alias("recent_mean"),
        F.avg(F.when(~is_recent, v)).alias("earlier_mean"),
        F.stddev_samp(v).alias("volatility"),
        ratio(F.stddev_samp(v), F.abs(F.avg(v))).alias("cv"),
    )
    start, end = F.col(f"first.{value}"), F.col(f"last.{value}")
    gap = F.greatest(F.lit(1.0), F.months_between(F.col("last.month"), F.col("first.month")))
    whole = F.col("_whole")
    sold = monthly.agg(F.sum(value).alias("w")).scalar()
    return stats.where("first IS NOT NULL").withColumn("_whole", sold).select(
        series,
        "total",
        "observed_months",
        F.col("first.month").alias("first_month"),
        start.alias("first_value"),
        end.alias("last_value"),
        (end - start).alias("abs_change"),
        F.when(
            start >= F.greatest(F.col("typical") * 0.1, F.lit(1.0)), (end - start) / start * 100
        ).alias("pct_change"),
        "recent_mean",
        "earlier_mean",
        F.when(
            F.abs("earlier_mean") > 1e-9,
            (F.col("recent_mean") - F.col("earlier_mean")) / F.col("earlier_mean") * 100,
        ).alias("recent_vs_earlier_pct"),
        F.when((start > 0) & (end > 0), F.pow(end / start, 1 / gap) - 1).alias("cmgr"),
        "volatility",
        "cv",
        (
            (F.col("total") >= F.greatest(whole * 0.005, F.lit(1.0)))
            & (F.col("observed_months") >= 6)
        ).alias("meaningful"),
    )


def early_late(monthly: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    """Mean month of the first against the second half of the observed months."""
    months = monthly.select("month").distinct()
    order = months.withColumns(
        {
            "_i": F.row_number().over(Window.orderBy("month")),
            "_n": F.count("*").over(Window.partitionBy()),
        }
    )
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    sides = order.select("month", (F.col("_i") <= half).alias("early"))
    sizes = sides.agg(F.count_if("early").alias("e"), F.count_if(~F.col("early")).alias("l"))
    sums = monthly.join(sides, "month").groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("early"), F.col(value))), F.lit(0.0)).alias("_early"),
        F.coalesce(F.sum(F.when(~F.col("early"), F.col(value))), F.lit(0.0)).alias("_late"),
    )
    placed = sums.withColumn("_n", sizes.select(F.struct("e", "l")).scalar())
    early, late = ratio(F.col("_early"), F.col("_n.e")), ratio(F.col("_late"), F.col("_n.l"))
    return placed.select(
        key,
        early.alias("early_mean"),
        late.alias("late_mean"),
        (late - early).alias("late_minus_early"),
        F.when(F.abs(early) > 1e-9, (late - early) / early * 100).alias("late_vs_early_pct"),
    )


# --- correlograms ---------------------------------------------------------------

def cross_correlation(df: DataFrame, target: str, features: Sequence[str], steps: Column, series: Sequence[str] = (), min_pairs: int = 2) -> DataFrame:
    """Correlation of ``target`` with each feature ``k`` days earlier.

    ``steps`` is an array of lags. Each row is copied once per lag and moved
    forward, so the join is an equi join on the date.
    """
    moved = df.select(
        *series, "date", F.explode(steps).alias("lag"), *[F.col(f).alias(f"_{f}") for f in features]
    ).withColumn("date", F.expr("date_add(date, CAST(lag AS INT))"))
    joined = df.select(*series, "date", F.col(target).alias("_target")).join(
        moved, [*series, "date"]
    )
    stats = joined.groupBy(*series, "lag").agg(
        *[safe_corr(F.col("_target"), F.col(f"_{f}")).alias(f"c_{f}") for f in features],
        *[
            F.count_if(F.col("_target").isNotNull() & F.col(f"_{f}").isNotNull()).alias(f"n_{f}")
            for f in features
        ],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.when(F.col(f"n_{f}") >= min_pairs, F.col(f"c_{f}")).alias("correlation"),
                F.col(f"n_{f}").alias("pairs"),
            )
            for f in features
        ]
    )
    return stats.select(*series, "lag", F.explode(entries).alias("e")).select(*series, "lag", "e.*")


def autocorrelation(df: DataFrame, value: str, max_lag: int = 365, series: Sequence[str] = (), min_pairs: int = 3) -> DataFrame:
    """Correlation of a dense series with itself ``k`` days earlier."""
    steps = F.sequence(F.lit(1), F.lit(max_lag))
    return cross_correlation(df, value, [value], steps, series, min_pairs).drop("feature")


def acf_peaks(acf: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Lags above both neighbours, with strength labels."""
    order = Window.partitionBy(*series).orderBy("lag")
    value = F.col("correlation")
    peak = (value > F.lag(value).over(order)) & (value > F.lead(value).over(order))
    return acf.withColumns(
        {"is_peak": F.coalesce(peak, F.lit(False)), "label": correlation_label(value)}
    )


# The lags that are checked for each cycle.
CYCLES = {"weekly": [7, 14, 21, 28], "monthly_like": [30, 60, 90], "yearly": [364, 365, 366]}


def cycle_check(acf: DataFrame, cycles: Mapping[str, Sequence[int]] = CYCLES) -> DataFrame:
    """Whether each cycle shows in the autocorrelation at its lags."""
    label = F.lit(None).cast("string")
    for name, steps in cycles.items():
        label = F.when(F.col("lag").isin(*steps), name).otherwise(label)
    stats = (
        acf.withColumn("cycle", label)
        .where("cycle IS NOT NULL")
        .groupBy("cycle")
        .agg(F.max("correlation").alias("max_corr"), F.avg("correlation").alias("mean_corr"))
    )
    verdict = (
        F.when(F.col("max_corr").isNull(), "not evaluated")
        .when((F.col("max_corr") >= 0.4) & (F.col("mean_corr") >= 0.2), "visible")
        .when(F.col("max_corr") >= 0.2, "weak or mixed")
        .otherwise("not clearly visible")
    )
    return stats.withColumn("verdict", verdict)


def lag_products(df: DataFrame, value: str, max_lag: int, series: Sequence[str] = ()) -> DataFrame:
    """Sums of products of a series with its lags, standardised: series, depth, place, total.

    A day with ``depth`` known values in a row counts with the vector (1, value, lag 1, ..., lag depth - 1), its depth being
    ``max_lag`` + 1 at most; ``place`` is that of a pair in :func:`gram`. The sample of lag k is all days of depth above k.
    """
    group = Window.partitionBy(*series)
    spread = F.stddev_samp(value).over(group)
    z = F.when(spread > 0, (F.col(value) - F.avg(value).over(group)) / spread).when(F.col(value).isNotNull(), F.lit(0.0))
    scored = df.select(*series, "date", z.alias("_z"))
    order = by_date(series)
    lags = scored.select(*series, F.array(*[F.lag("_z", k).over(order) for k in range(max_lag + 1)]).alias("_v"))
    gap = F.array_position(F.transform("_v", lambda v: v.isNull()), True)
    depth = F.when(gap > 0, gap - 1).otherwise(max_lag + 1).cast("int")
    known = lags.withColumn("depth", depth)
    return gram(known, [*series, "depth"], F.concat(F.array(F.lit(1.0)), F.slice("_v", F.lit(1), F.col("depth"))))


def partial_autocorrelation(df: DataFrame, value: str, max_lag: int = 60, series: str | None = None, min_pairs: int = 20) -> DataFrame:
    """Correlation of residuals after the lags in between are fitted away.

    Only sums of products leave the tasks that hold a series; a lag's correlation is read from a Cholesky factor of its
    sums. It is null with fewer days than ``min_pairs`` or the lag plus 5, and where the lags in between leave nothing.
    """
    label = F.col(series).cast("string") if series else F.lit("all")
    rows = df.select(label.alias("series"), "date", F.col(value).cast("double").alias("value"))

    def correlogram(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        out, size = [], max_lag + 2
        seen = round(sums.loc[sums["place"] == 0, "total"].sum())
        total = np.zeros((size, size))
        parts = {depth: square(p["place"].to_numpy(), p["total"].to_numpy()) for depth, p in sums.groupby("depth")}
        for lag in range(max_lag, 0, -1):
            part = parts.get(lag + 1)
            if part is not None:
                total[: lag + 2, : lag + 2] += part
            if lag > seen - 2:
                continue
            pairs = round(total[0, 0])
            order = [0, *range(2, lag + 1), 1, lag + 1]  # the constant and the lags in between come first
            result = None
            if pairs >= max(min_pairs, lag + 5):
                own = total[np.ix_(order, order)]
                a, b, c, d = own[:-2, :-2], own[:-2, -2:], own[-2:, -2:], 1e-10 * pairs
                rest = c - b.T @ _solved(a, b)
                if rest[0, 0] > d and rest[1, 1] > d:
                    result = float(rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1]))
            out.append((key[0], lag, result, pairs))
        return pd.DataFrame(out[::-1], columns=["series", "lag", "partial_correlation", "pairs"])

    schema = T.StructType(
        [
            T.StructField("series", T.StringType()),
            T.StructField("lag", T.LongType()),
            T.StructField("partial_correlation", T.DoubleType()),
            T.StructField("pairs", T.LongType()),
        ]
    )
    return lag_products(rows, "value", max_lag, ["series"]).groupBy("series").applyInPandas(correlogram, schema)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system, by a Cholesky factor or, where lags depend on each other, in least squares."""
    try:
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def sign_changes(df: DataFrame, value: str, series: Sequence[str] = ()) -> DataFrame:
    """How often a series changes its sign from one value to the next."""
    known = df.where(F.col(value).isNotNull())
    sign = F.signum(value)
    flipped = sign != F.lag(sign).over(by_date(series))
    return known.withColumn("_flip", flipped).groupBy(*series).agg(
        F.count("*").alias("values"), F.count_if(F.coalesce("_flip", F.lit(False))).alias("sign_changes")
    )


# --- events ---------------------------------------------------------------------

def event_days(events: DataFrame, key: str, date: str) -> DataFrame:
    """Distinct event days per key with their event count and the gap before.

    Events are counted per day first, so even a hot key has at most one row per
    calendar day in the window.
    """
    days = events.groupBy(key, F.to_date(date).alias("date")).agg(F.count("*").alias("events"))
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(key).orderBy("date")))
    return days.withColumn("gap_days", gap)


def gap_summary(events: DataFrame, key: str, date: str) -> DataFrame:
    """Distribution of the days between neighbouring events of a key.

    Events on the same day are zero days apart; gaps are counted per length before
    the median is taken, so the ordering covers distinct lengths only.
    """
    days = event_days(events, key, date)
    lengths = days.where("gap_days IS NOT NULL").groupBy("gap_days").agg(F.count("*").alias("n"))
    same_day = days.agg(F.sum(F.col("events") - 1).alias("n")).select(
        F.lit(0).alias("gap_days"), "n"
    )
    counts = lengths.unionByName(same_day).where("n > 0")
    return counts.agg(
        F.sum("n").alias("gaps"),
        ratio(F.sum(F.col("gap_days") * F.col("n")), F.sum("n")).alias("mean_gap"),
        F.percentile("gap_days", F.lit(0.5), F.col("n")).alias("median_gap"),
        F.max("gap_days").alias("longest_gap"),
    )


# --- picks ----------------------------------------------------------------------

def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def spaced_top(df: DataFrame, score: str, gap: int = 90, n: int = 12, series: Sequence[str] = ()) -> DataFrame:
    """Best-scored dates that keep ``gap`` days (one at least) apart, at most ``n`` per series; ties go to the earlier date.

    Days without a score, or with NaN, take no part; of repeated days the best score counts. A date that no other open one within ``gap`` days beats is taken, and the days around it are closed. A series is worked
    on in blocks of days which carry the days of both borders along, so its length doesn't matter to a task. The best
    open date of a series is always taken, so ``n`` rounds are enough; a few do unless scores rise over years.
    """
    reach = max(gap, 1) - 1
    span = 8 * (reach + 1)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    open_days = (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*series, "date")
        .agg(F.max(score).alias("_score"))
        .select(*series, "date", F.struct("_score", (-day).alias("early")).alias("_place"), day.alias("_day"), F.lit(False).alias("_taken"))
    )
    state = checkpointed(open_days)
    own = F.floor(F.col("_day") / span)
    around = Window.partitionBy(*series, "_block").orderBy("_day").rangeBetween(-reach, reach)
    for _ in range(n):
        # both windows reach out, so a block needs the days of twice the reach beyond its ends
        blocks = F.sequence(F.floor((F.col("_day") - 2 * reach) / span), F.floor((F.col("_day") + 2 * reach) / span))
        rows = state.withColumn("_block", F.explode(blocks))
        best = F.max(F.when(~F.col("_taken"), F.col("_place"))).over(around)
        rows = rows.withColumn("_peak", F.col("_taken") | (F.col("_place") == best))
        closed = F.bool_or("_peak").over(around) & ~F.col("_peak")
        kept = rows.withColumn("_closed", closed).where((F.col("_block") == own) & ~F.col("_closed"))
        state = checkpointed(kept.select(*series, "date", "_place", "_day", F.col("_peak").alias("_taken")))
        if state.where("NOT _taken").isEmpty():
            break
    top = top_per_group(state.where("_taken"), series, [F.desc("_place")], n)
    return top.select(*series, "date")
