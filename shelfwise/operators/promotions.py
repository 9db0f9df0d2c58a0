"""Promotion usage, calendars, comparisons, lift and discount response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import null_safe_join, positions, quantiles
from shelfwise.functions.scalars import equal_count_bin, ratio
from shelfwise.operators.aggregate import distinct_list
from shelfwise.operators.joins import expand_intervals
from shelfwise.operators.timeseries import expanding_mean, lags, rolled


def promo_usage(items: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Line ratio, quantity share and revenue share of promotion lines."""
    used = F.col("promo_used")
    part = lambda c: F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0.0))
    return items.groupBy(*groups).agg(
        F.count("*").alias("lines"),
        F.count_if(used).alias("promo_lines"),
        F.count_distinct("promo_id").alias("promos"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        ratio(F.count_if(used), F.count("*")).alias("line_ratio"),
        ratio(part("quantity"), F.sum("quantity")).alias("quantity_share"),
        ratio(part("revenue"), F.sum("revenue")).alias("revenue_share"),
    )


def promo_seasonality(daily_usage: DataFrame, part: Column) -> DataFrame:
    """Mean usage per calendar part."""
    return daily_usage.groupBy(part.alias("part")).agg(
        F.avg("line_ratio").alias("mean_line_ratio"),
        F.avg("revenue_share").alias("mean_revenue_share"),
        F.count("*").alias("days"),
    )


def promo_calendar(promotions: DataFrame, days: DataFrame) -> DataFrame:
    """Per day: active promotions by type, discounts and the first twenty ids."""
    expanded = expand_intervals(promotions, "start_date", "end_date")
    kind = F.col("promo_type")
    active = expanded.groupBy("date").agg(
        F.count_distinct("promo_id").alias("active_promos"),
        F.count_if(kind == "percentage").alias("percentage_promos"),
        F.count_if(kind == "fixed").alias("fixed_promos"),
        F.count_if(~kind.isin("percentage", "fixed")).alias("other_promos"),
        F.avg("discount_value").alias("mean_discount"),
        F.max("discount_value").alias("max_discount"),
        F.min("discount_value").alias("min_discount"),
    )
    ids = distinct_list(expanded, ["date"], "promo_id").select(
        "date", F.col("values").alias("promo_ids")
    )
    counts = ["active_promos", "percentage_promos", "fixed_promos", "other_promos"]
    return (
        days.select("date")
        .join(active, "date", "left")
        .join(ids, "date", "left")
        .fillna(0, counts)
        .fillna("", ["promo_ids"])
        .withColumn("has_promo", F.col("active_promos") > 0)
    )


def promo_type_summary(promotions: DataFrame) -> DataFrame:
    """Promotions, durations, discounts and active days per type."""
    length = F.datediff("end_date", "start_date") + 1
    return promotions.groupBy("promo_type").agg(
        F.count_distinct("promo_id").alias("promos"),
        F.avg(length).alias("mean_days"),
        F.percentile(length, F.lit(0.5)).alias("median_days"),
        F.avg("discount_value").alias("mean_discount"),
        F.percentile("discount_value", F.lit(0.5)).alias("median_discount"),
        F.sum(F.greatest(length, F.lit(0))).alias("active_days"),
    )


def promo_calendar_matrix(calendar: DataFrame) -> DataFrame:
    """Mean active promotions and active days per year and month."""
    return calendar.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.avg("active_promos").alias("mean_active"),
        F.count_if("has_promo").alias("active_days"),
        F.count("*").alias("days"),
        ratio(F.count_if("has_promo"), F.count("*")).alias("active_rate"),
    )


def overlap_label(count: Column) -> Column:
    """Bin of the number of promotions active on a day."""
    return (
        F.when(count <= 0, "0 active promos")
        .when(count <= 1, "1 active promo")
        .when(count <= 3, "2-3 active promos")
        .otherwise("4+ active promos")
    )


def type_label() -> Column:
    """Kind of promotions active on a day."""
    some = lambda c: F.col(c) > 0
    return (
        F.when(some("percentage_promos") & some("fixed_promos"), "mixed percentage and fixed")
        .when(some("percentage_promos"), "percentage promo active")
        .when(some("fixed_promos"), "fixed promo active")
        .when(some("other_promos"), "other/unknown promo active")
        .otherwise("no active promo")
    )


def promo_days_comparison(daily: DataFrame, calendar: DataFrame, label: Column) -> DataFrame:
    """Daily revenue, orders and order value per label of the promotion calendar."""
    joined = daily.join(calendar, "date").withColumn("label", label)
    return joined.groupBy("label").agg(
        F.count("*").alias("days"),
        F.sum("revenue").alias("revenue"),
        F.avg("revenue").alias("mean_revenue"),
        F.percentile("revenue", F.lit(0.5)).alias("median_revenue"),
        F.avg("orders").alias("mean_orders"),
        F.avg(ratio(F.col("revenue"), F.col("orders"))).alias("mean_aov"),
    )


def promo_line_comparison(lines: DataFrame, group: str = "promo_used") -> DataFrame:
    """Lines, quantity, revenue, discount, profit and margin with and without promotion."""
    sums = lines.groupBy(group).agg(
        F.count("*").alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        F.avg("revenue").alias("mean_revenue"),
        F.avg("quantity").alias("mean_quantity"),
        F.avg("discount_amount").alias("mean_discount"),
        F.avg("discount_rate").alias("mean_rate"),
        F.sum("profit").alias("profit"),
        ratio(F.sum("profit"), F.sum("revenue")).alias("margin"),
    )
    return null_safe_join(sums, quantiles(lines, "revenue", {"median_revenue": 0.5}, [group]), [group], "left")


def promo_daily_decomposition(lines: DataFrame) -> DataFrame:
    """Promotion and other revenue, quantity, lines and profit per day with shares."""
    used = F.col("promo_used")
    side = lambda c, on: F.coalesce(F.sum(F.when(used == on, F.col(c))), F.lit(0.0))
    sums = lines.groupBy(F.col("order_date").alias("date")).agg(
        *[
            side(c, on).alias(f"{name}_{c}")
            for name, on in (("promo", True), ("plain", False))
            for c in ("revenue", "quantity", "profit")
        ],
        F.count_if(used).alias("promo_lines"),
        F.count("*").alias("lines"),
    )
    both = lambda c: F.col(f"promo_{c}") + F.col(f"plain_{c}")
    return sums.withColumns(
        {
            "revenue_share": ratio(F.col("promo_revenue"), both("revenue")),
            "quantity_share": ratio(F.col("promo_quantity"), both("quantity")),
            "line_ratio": ratio(F.col("promo_lines"), F.col("lines")),
            "margin": ratio(both("profit"), both("revenue")),
            "promo_margin": ratio(F.col("promo_profit"), F.col("promo_revenue")),
            "plain_margin": ratio(F.col("plain_profit"), F.col("plain_revenue")),
            "promo_day": F.col("promo_lines") > 0,
        }
    )


def promo_profit_by_year(lines: DataFrame) -> DataFrame:
    """Revenue, cost and profit per year with and without promotion id."""
    return lines.groupBy(
        F.year("order_date").alias("year"), F.col("promo_id").isNotNull().alias("has_promo")
    ).agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("revenue"),
        F.sum("cost").alias("cost"),
        F.sum(F.col("quantity") * F.col("unit_price") - F.col("cost")).alias("profit"),
    )


def promo_lift(lines: DataFrame, group: str, small: int = 100) -> DataFrame:
    """Promotion lines against others per group: usage, lift, margin gap."""
    used = F.col("promo_used")
    mean = lambda c, on: F.avg(F.when(used == on, F.col(c)))
    total = lambda c, on: F.sum(F.when(used == on, F.col(c)))
    margin = lambda on: ratio(total("profit", on), total("revenue", on))
    return lines.groupBy(group).agg(
        F.count("*").alias("lines"),
        ratio(F.count_if(used), F.count("*")).alias("usage_rate"),
        ratio(total("revenue", True), F.sum("revenue")).alias("revenue_share"),
        ratio(mean("quantity", True), mean("quantity", False)).alias("quantity_lift"),
        ratio(mean("revenue", True), mean("revenue", False)).alias("revenue_lift"),
        margin(True).alias("promo_margin"),
        margin(False).alias("plain_margin"),
        (margin(True) - margin(False)).alias("margin_gap"),
        (F.count("*") < small).alias("small_sample"),
    )


def discount_response(lines: DataFrame, order: Sequence[str], bins: int = 5) -> DataFrame:
    """Quantity, revenue and margin per equal-count bin of the discount rate."""
    known = lines.where("discount_rate > 0").select(
        "discount_rate", "quantity", "revenue", "profit", *order
    )
    ranks = ["discount_rate", *order, "quantity", "revenue"]
    placed = positions(known, [F.col(c) for c in ranks])
    size = known.agg(F.count("*").alias("n")).scalar()
    margin = ratio(F.col("profit"), F.col("revenue"))
    return (
        placed.withColumn("_n", size)
        .withColumn("bin", equal_count_bin(F.col("position"), F.col("_n"), bins))
        .groupBy("bin")
        .agg(
            F.count("*").alias("lines"),
            F.min("discount_rate").alias("min_rate"),
            F.max("discount_rate").alias("max_rate"),
            F.avg("quantity").alias("mean_quantity"),
            F.sum("revenue").alias("revenue"),
            F.avg(margin).alias("mean_margin"),
        )
    )


def promo_tradeoff(lines: DataFrame, promotions: DataFrame, calendar_days: DataFrame) -> DataFrame:
    """Revenue, profit, active days, daily revenue, margin and index by promotion type.

    The index is the daily revenue over the median of all types, in percent.
    """
    kinds = promotions.select("promo_id", "promo_type")
    typed = lines.join(kinds, "promo_id", "left").withColumn(
        "promo_type", F.coalesce("promo_type", F.lit("no_promo"))
    )
    sums = typed.groupBy("promo_type").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")
    )
    active = (
        expand_intervals(promotions, "start_date", "end_date")
        .select("promo_type", "date")
        .distinct()
        .join(calendar_days.select("date"), "date")
        .groupBy("promo_type")
        .agg(F.count("*").alias("active_days"))
    )
    all_days = calendar_days.agg(F.count("*").alias("n")).scalar()
    out = sums.join(active, "promo_type", "left").withColumn(
        "active_days", F.coalesce("active_days", all_days)
    )
    daily = ratio(F.col("revenue"), F.col("active_days"))
    middle = F.percentile("daily_revenue", F.lit(0.5)).over(Window.partitionBy())
    return out.withColumns(
        {
            "daily_revenue": daily,
            "margin_pct": ratio(F.col("profit") * 100, F.col("revenue")),
        }
    ).withColumn("performance_index", ratio(F.col("daily_revenue"), middle) * 100)


def promo_features(daily: DataFrame) -> DataFrame:
    """Lags and leak-safe means of the line ratio and its history for the month of year."""
    out = lags(daily, ["line_ratio"], [1, 7, 30]).withColumns(
        {
            "line_ratio_roll_mean_7": rolled("line_ratio", 7, "mean", 3, 1),
            "line_ratio_roll_mean_30": rolled("line_ratio", 30, "mean", 7, 1),
            "moy": F.month("date"),
        }
    )
    return expanding_mean(out, "line_ratio", ["moy"], 7)
