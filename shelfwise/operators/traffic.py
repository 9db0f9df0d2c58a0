"""Web traffic: daily totals, source quality, efficiency and conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import (
    at_least,
    at_most,
    is_completed,
    ratio,
    repair_ratio,
    weighted_mean,
)
from shelfwise.operators.aggregate import correlations, safe_corr, spearman
from shelfwise.operators.timeseries import index_to_base, lags, rolled, trend_direction


def traffic_daily(traffic: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Summed volumes and session-weighted quality per day (and source)."""
    return traffic.groupBy(*keys).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("unique_visitors").alias("unique_visitors"),
        F.sum("page_views").alias("page_views"),
        weighted_mean(repair_ratio(F.col("bounce_rate")), F.col("sessions")).alias("bounce_rate"),
        weighted_mean(F.col("avg_session_duration_sec"), F.col("sessions")).alias("session_duration"),
    )


def traffic_trends(daily: DataFrame, metrics: Sequence[str], edge: int = 30, least: int = 60) -> DataFrame:
    """Trend direction of each metric."""
    casted = daily.select("date", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = casted.unpivot(["date"], [*metrics], "metric", "value")
    return trend_direction(long, "value", ["metric"], edge, least)


def source_quality(traffic: DataFrame) -> DataFrame:
    """Weighted and median quality, share and sparse, weak and strong flags per source."""
    stats = traffic.groupBy("traffic_source").agg(
        F.sum("sessions").alias("sessions"),
        F.count_distinct("date").alias("active_days"),
        weighted_mean(F.col("bounce_rate"), F.col("sessions")).alias("bounce_rate"),
        F.percentile("bounce_rate", F.lit(0.5)).alias("median_bounce"),
        weighted_mean(F.col("avg_session_duration_sec"), F.col("sessions")).alias("duration"),
        ratio(F.sum("page_views"), F.sum("sessions")).alias("pages_per_session"),
        ratio(F.sum("sessions"), F.sum("unique_visitors")).alias("sessions_per_visitor"),
    )
    everything = Window.partitionBy()
    shared = stats.withColumn("share", ratio(F.col("sessions"), F.sum("sessions").over(everything)))
    cut = lambda c, p: F.percentile(c, F.lit(p)).over(everything)
    return shared.withColumns(
        {
            "sparse": F.col("share") < 0.01,
            "weak_quality": (F.col("share") >= cut("share", 0.75))
            & (F.col("bounce_rate") >= cut("bounce_rate", 0.75)),
            "strong_low_volume": (F.col("share") <= cut("share", 0.25))
            & (F.col("bounce_rate") <= cut("bounce_rate", 0.25)),
        }
    )


def traffic_efficiency(daily: DataFrame) -> DataFrame:
    """Revenue per session and visitor per day with high- and low-yield flags."""
    per = lambda a, b: ratio(F.col(a), F.col(b))
    base = daily.withColumns(
        {
            "revenue_per_session": per("revenue", "sessions"),
            "revenue_per_visitor": per("revenue", "unique_visitors"),
            "pages_per_session": per("page_views", "sessions"),
            "sessions_per_visitor": per("sessions", "unique_visitors"),
        }
    )
    cuts = base.agg(
        F.percentile("sessions", F.lit(0.9)).alias("s_high"),
        F.percentile("sessions", F.lit(0.1)).alias("s_low"),
        F.percentile("revenue_per_session", F.lit(0.9)).alias("r_high"),
        F.percentile("revenue_per_session", F.lit(0.1)).alias("r_low"),
    ).select(F.struct("*")).scalar()
    return base.withColumn("_c", cuts).withColumns(
        {
            "busy_low_yield": (at_least(F.col("sessions"), F.col("_c.s_high")))
            & (at_most(F.col("revenue_per_session"), F.col("_c.r_low"))),
            "calm_high_yield": (at_most(F.col("sessions"), F.col("_c.s_low")))
            & (at_least(F.col("revenue_per_session"), F.col("_c.r_high"))),
        }
    ).drop("_c")


def traffic_revenue_correlation(daily: DataFrame, metrics: Sequence[str], steps: Sequence[int] = (1, 7)) -> DataFrame:
    """Same-day and lagged correlation of revenue with each traffic metric."""
    wide = lags(daily, metrics, steps)
    pairs = [("revenue", c) for m in metrics for c in (m, *[f"{m}_lag_{k}" for k in steps])]
    return correlations(wide, pairs)


def conversion_proxy(traffic: DataFrame, orders: DataFrame, grain: str = "day") -> DataFrame:
    """Orders over sessions and revenue per session; sums first, ratios last."""
    part = lambda c: F.to_date(F.date_trunc(grain, c)).alias("period")
    seen = traffic.groupBy(part("date")).agg(F.sum("sessions").alias("sessions"))
    done = is_completed(F.col("order_status"))
    bought = orders.groupBy(part("order_date")).agg(
        F.count("*").alias("orders"),
        F.count_if(done).alias("completed_orders"),
        F.sum("order_value").alias("revenue"),
    )
    joined = seen.join(bought, "period", "left").fillna(0, ["orders", "completed_orders", "revenue"])
    return joined.withColumns(
        {
            "conversion_pct": ratio(F.col("orders") * 100.0, F.col("sessions")),
            "completed_pct": ratio(F.col("completed_orders") * 100.0, F.col("sessions")),
            "revenue_per_session": ratio(F.col("revenue"), F.col("sessions")),
            "aov": ratio(F.col("revenue"), F.col("orders")),
        }
    )


def conversion_by_source(traffic: DataFrame, orders: DataFrame, source: str, period: Column, order_period: Column) -> DataFrame:
    """Sessions, orders and conversion per source and period."""
    a = traffic.groupBy(F.col("traffic_source").alias("source"), period.alias("period")).agg(
        F.sum("sessions").alias("sessions"), F.avg("bounce_rate").alias("bounce_rate")
    )
    b = orders.groupBy(F.col(source).alias("source"), order_period.alias("period")).agg(
        F.count("*").alias("orders")
    )
    joined = a.join(b, ["source", "period"], "left").fillna(0, ["orders"])
    return joined.withColumn("conversion_pct", ratio(F.col("orders") * 100.0, F.col("sessions")))


def conversion_sensitivity(periods: DataFrame, split: str) -> DataFrame:
    """Correlations of sessions with conversion and means before and after a day."""
    ranks = spearman(periods, "sessions", "conversion_pct")
    early = F.col("period") < F.lit(split).cast("date")
    row = periods.agg(
        safe_corr(F.col("sessions"), F.col("conversion_pct")).alias("pearson"),
        F.avg(F.when(early, F.col("conversion_pct"))).alias("mean_before"),
        F.avg(F.when(~early, F.col("conversion_pct"))).alias("mean_after"),
        F.avg((F.col("conversion_pct") - F.col("completed_pct")) * 100).alias("mean_gap_bps"),
    )
    return row.withColumn("spearman", ranks.select("spearman").scalar())


def conversion_smoothed(periods: DataFrame) -> DataFrame:
    """Conversion with trailing means of three and six periods."""
    return periods.withColumns(
        {
            f"conversion_{w}": rolled("conversion_pct", w, "mean", 2, 0, (), "period")
            for w in (3, 6)
        }
    )


def conversion_index(periods: DataFrame, base: str) -> DataFrame:
    """Sessions, orders, revenue and conversion indexed to a base period."""
    keyed = periods.withColumn("key", F.col("period").cast("string"))
    return index_to_base(keyed, ["sessions", "orders", "revenue", "conversion_pct"], "key", base)


def promo_traffic_interaction(daily: DataFrame) -> DataFrame:
    """Revenue against sessions on promotion days and on other days."""
    return daily.groupBy("has_promo").agg(
        F.count("*").alias("days"),
        safe_corr(F.col("revenue"), F.col("sessions")).alias("correlation"),
        ratio(F.sum("revenue"), F.sum("sessions")).alias("revenue_per_session"),
        F.regr_slope("revenue", "sessions").alias("slope"),
    )


def interaction_correlations(daily: DataFrame) -> DataFrame:
    """Correlation of revenue with sessions of today and earlier on promotion days."""
    on = F.col("has_promo").cast("int")
    wide = lags(daily, ["sessions"], [1, 7]).withColumns(
        {
            "sessions_x_promo": F.col("sessions") * on,
            "sessions_lag_1_x_promo": F.col("sessions_lag_1") * on,
            "sessions_lag_7_x_promo": F.col("sessions_lag_7") * on,
        }
    )
    names = ["sessions_x_promo", "sessions_lag_1_x_promo", "sessions_lag_7_x_promo"]
    return correlations(wide, [("revenue", n) for n in names])


def spike_context(daily: DataFrame) -> DataFrame:
    """Top revenue days by whether traffic was high and a promotion active."""
    cuts = daily.agg(
        F.percentile("revenue", F.lit(0.95)).alias("r"), F.percentile("sessions", F.lit(0.9)).alias("s")
    ).select(F.struct("*")).scalar()
    busy, promo = at_least(F.col("sessions"), F.col("_c.s")), F.coalesce("has_promo", F.lit(False))
    label = (
        F.when(busy & promo, "high_traffic_plus_promo")
        .when(busy, "high_traffic_only")
        .when(promo, "promo_only")
        .otherwise("unclear")
    )
    spikes = daily.withColumn("_c", cuts).where(at_least(F.col("revenue"), F.col("_c.r")))
    return spikes.withColumn("context", label).drop("_c")


def source_effectiveness(traffic: DataFrame, daily: DataFrame) -> DataFrame:
    """Sessions, revenue and their correlation per source with and without promotion."""
    joined = traffic.select("date", "traffic_source", F.col("sessions").alias("s")).join(
        daily.select("date", "revenue", "has_promo"), "date"
    )
    return joined.groupBy("traffic_source", "has_promo").agg(
        F.sum("s").alias("sessions"),
        F.avg("s").alias("mean_sessions"),
        F.avg("revenue").alias("mean_revenue"),
        ratio(F.sum("revenue"), F.sum("s")).alias("revenue_per_session"),
        safe_corr(F.col("revenue"), F.col("s")).alias("correlation"),
    )

