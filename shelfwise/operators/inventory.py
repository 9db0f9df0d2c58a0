"""Inventory: stock-outs, overstock, reorders and their link to revenue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import null_safe_join, quantiles, quantiles_of
from shelfwise.functions.scalars import at_least, at_most, month_start, ratio
from shelfwise.operators.aggregate import correlations, safe_corr
from shelfwise.operators.joins import month_to_day
from shelfwise.operators.timeseries import by_date, rolled


def flagged(name: str) -> Column:
    """Flag with missing read as false."""
    return F.coalesce(name, F.lit(False))


def stockout_monthly(inventory: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """Records, stock-outs, rate, stock, fill rate and days out of stock per month.

    Rows are totalled per product first: products are then counted without a copy of every row for each distinct count.
    """
    out = flagged("stockout_flag")
    own = [] if "product_id" in keys else ["product_id"]
    products = inventory.groupBy(*keys, *own).agg(
        F.count("*").alias("records"),
        F.count_if(out).alias("stockouts"),
        F.sum("stockout_days").alias("stockout_days"),
        *[e(c).alias(f"{n}_{c}") for c in ("stock_on_hand", "fill_rate") for n, e in (("sum", F.sum), ("count", F.count))],
    )
    mean = lambda c: ratio(F.sum(f"sum_{c}"), F.sum(f"count_{c}"))
    return products.groupBy(*keys).agg(
        F.sum("records").alias("records"),
        F.sum("stockouts").alias("stockouts"),
        ratio(F.sum("stockouts"), F.sum("records")).alias("stockout_rate"),
        F.count_if(F.col("product_id").isNotNull() & (F.col("stockouts") > 0)).alias("stockout_products"),
        mean("stock_on_hand").alias("mean_stock"),
        mean("fill_rate").alias("mean_fill_rate"),
        F.sum("stockout_days").alias("stockout_days"),
        ratio(F.sum("stockout_days"), F.count("product_id")).alias("days_per_product"),
    )


def stockout_by(inventory: DataFrame, group: str) -> DataFrame:
    """Stock-outs per group with its worst month and a small-sample flag."""
    out = flagged("stockout_flag")
    sums = inventory.groupBy(group).agg(
        F.count_distinct("product_id").alias("products"),
        F.count("*").alias("records"),
        F.count_if(out).alias("stockouts"),
        ratio(F.count_if(out), F.count("*")).alias("stockout_rate"),
        F.avg("fill_rate").alias("mean_fill_rate"),
    )
    months = inventory.groupBy(group, "month").agg(ratio(F.count_if(out), F.count("*")).alias("rate"))
    worst = months.groupBy(group).agg(F.max(F.struct("rate", "month")).alias("w"))
    small = F.greatest(F.lit(10.0), F.percentile("records", F.lit(0.1)).over(Window.partitionBy()))
    return sums.join(worst, group).select(
        *sums.columns,
        F.col("w.month").alias("worst_month"),
        F.col("w.rate").alias("worst_rate"),
        (F.col("records") < small).alias("small_sample"),
    )


def low_revenue_months(monthly: DataFrame) -> DataFrame:
    """Months at P10, 1.5 deviations below the mean, or below 85 % of the last three."""
    stats = monthly.agg(
        F.percentile("revenue", F.lit(0.1)).alias("p10"),
        F.avg("revenue").alias("mean"),
        F.stddev_samp("revenue").alias("std"),
    ).select(F.struct("*")).scalar()
    base = monthly.withColumn("_s", stats).withColumn(
        "prior_3", rolled("revenue", 3, "mean", 2, 1, (), "month")
    )
    z = ratio(F.col("revenue") - F.col("_s.mean"), F.col("_s.std"))
    low = (
        (at_most(F.col("revenue"), F.col("_s.p10")))
        | F.coalesce(z <= -1.5, F.lit(False))
        | F.coalesce(F.col("revenue") < 0.85 * F.col("prior_3"), F.lit(False))
    )
    return base.withColumns({"z": z, "low_revenue": low}).drop("_s")


def stockout_vs_revenue(stock_months: DataFrame, monthly: DataFrame) -> DataFrame:
    """Correlation of monthly revenue with each stock-out metric."""
    joined = stock_months.join(monthly.select("month", "revenue"), "month")
    metrics = ["stockout_days", "stockouts", "stockout_rate", "mean_fill_rate"]
    return correlations(joined, [("revenue", m) for m in metrics])


def stockout_overlap(stock_months: DataFrame, monthly: DataFrame) -> DataFrame:
    """Months by low revenue and stock-out rate at or above P75."""
    joined = stock_months.select("month", "stockout_rate").join(low_revenue_months(monthly), "month")
    cut = joined.agg(F.percentile("stockout_rate", F.lit(0.75)).alias("c")).scalar()
    marked = joined.withColumn("_c", cut).withColumn(
        "high_stockout", at_least(F.col("stockout_rate"), F.col("_c"))
    )
    return marked.groupBy("low_revenue", "high_stockout").agg(
        F.count("*").alias("months"), F.avg("revenue").alias("mean_revenue")
    )


def best_seller_stockouts(inventory: DataFrame, n: int = 20) -> DataFrame:
    """Stock-outs of the products that sold most."""
    return (
        inventory.groupBy("product_id")
        .agg(
            F.sum("units_sold").alias("units_sold"),
            F.count_if(flagged("stockout_flag")).alias("stockouts"),
            F.sum("stockout_days").alias("stockout_days"),
            F.min("category").alias("category"),
        )
        .orderBy(F.desc("units_sold"), "product_id")
        .limit(n)
    )


def units_sold_monthly(lines: DataFrame) -> DataFrame:
    """Units and revenue per product and month, rebuilt from the orders."""
    return lines.groupBy("product_id", month_start(F.col("order_date")).alias("month")).agg(
        F.sum("quantity").alias("units_sold"), F.sum("revenue").alias("revenue")
    )


def overstock(product_months: DataFrame, group: str = "category") -> DataFrame:
    """Product months with much stock and slow sales within their group."""
    days = F.dayofmonth(F.last_day("month"))
    base = product_months.withColumns(
        {
            "sell_through": F.when(F.col("stock_on_hand") > 0, F.col("units_sold") / F.col("stock_on_hand")),
            "stock_to_sales": F.when(F.col("units_sold") > 0, F.col("stock_on_hand") / F.col("units_sold")),
            "supply_days": F.when(
                F.col("units_sold") > 0, F.col("stock_on_hand") / (F.col("units_sold") / days)
            ),
        }
    )
    marks = {"stock_on_hand": {"stock_p75": 0.75}, "units_sold": {"sales_p50": 0.5}, "sell_through": {"through_p25": 0.25}}
    joined = null_safe_join(base, quantiles_of(base, marks, [group]), [group], "left")
    high = F.col("stock_on_hand") >= F.col("stock_p75")
    slow = F.coalesce("units_sold", F.lit(0.0)) <= F.coalesce("sales_p50", F.lit(0.0))
    weak = F.coalesce(F.col("sell_through") <= F.col("through_p25"), F.lit(False))
    return joined.withColumn("is_overstock", F.coalesce(high & (slow | weak), F.lit(False)))


def overstock_by(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Products, stock, sales, sell-through and overstock rate per group or month."""
    return marked.groupBy(*keys).agg(
        F.count_distinct("product_id").alias("products"),
        F.sum("stock_on_hand").alias("stock"),
        F.sum("units_sold").alias("units_sold"),
        F.avg("sell_through").alias("mean_sell_through"),
        F.count_if("is_overstock").alias("overstocked"),
        ratio(F.count_if("is_overstock"), F.count("*")).alias("overstock_rate"),
        F.avg("supply_days").alias("mean_supply_days"),
    )


def slow_movers(marked: DataFrame, n: int = 20) -> DataFrame:
    """Products with the most stock per unit sold among those with much stock."""
    products = marked.groupBy("product_id").agg(
        F.avg("stock_on_hand").alias("mean_stock"),
        F.sum("units_sold").alias("units_sold"),
        F.count_if("is_overstock").alias("overstock_months"),
    )
    cut = quantiles(products, "mean_stock", {"c": 0.75}).scalar()
    return (
        products.withColumn("_c", cut)
        .where(at_least(F.col("mean_stock"), F.col("_c")))
        .orderBy("units_sold", F.desc("mean_stock"), "product_id")
        .limit(n)
        .drop("_c")
    )


def reorder_supply(inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reorders, quantities, fill rate and days of supply per product, group or month."""
    return inventory.groupBy(*keys).agg(
        F.count("*").alias("periods"),
        F.count_distinct("product_id").alias("products"),
        F.count_if(flagged("reorder_flag")).alias("reorders"),
        ratio(F.count_if(flagged("reorder_flag")), F.count("*")).alias("reorder_rate"),
        F.avg("reorder_quantity").alias("mean_reorder_quantity"),
        F.avg("fill_rate").alias("mean_fill_rate"),
        F.avg("days_of_supply").alias("mean_days_of_supply"),
        F.avg("stock_on_hand").alias("mean_stock"),
    )


def supply_vs_next_month(supply_months: DataFrame, monthly: DataFrame) -> DataFrame:
    """Correlation of supply metrics with the revenue of the next month."""
    ahead = monthly.select(F.add_months("month", -1).alias("month"), F.col("revenue").alias("next_revenue"))
    joined = supply_months.join(ahead, "month")
    metrics = ["reorders", "reorder_rate", "mean_days_of_supply", "mean_fill_rate"]
    return correlations(joined, [(m, "next_revenue") for m in metrics])


def supply_extremes(supply_months: DataFrame, monthly: DataFrame) -> DataFrame:
    """Revenue in months with low, normal and high days of supply."""
    joined = supply_months.join(monthly.select("month", "revenue"), "month")
    cuts = joined.agg(
        F.percentile("mean_days_of_supply", F.lit(0.25)).alias("low"),
        F.percentile("mean_days_of_supply", F.lit(0.75)).alias("high"),
    ).select(F.struct("*")).scalar()
    label = (
        F.when(at_most(F.col("mean_days_of_supply"), F.col("_c.low")), "low_supply")
        .when(at_least(F.col("mean_days_of_supply"), F.col("_c.high")), "high_supply")
        .otherwise("normal_supply")
    )
    return joined.withColumn("_c", cuts).groupBy(label.alias("supply_group")).agg(
        F.count("*").alias("months"),
        F.avg("revenue").alias("mean_revenue"),
        F.avg("reorder_rate").alias("mean_reorder_rate"),
    )


def leading_indicator(inventory: DataFrame, monthly: DataFrame) -> DataFrame:
    """Monthly days of supply, stock and overstock rate next to next month's revenue."""
    months = inventory.groupBy(month_start(F.col("snapshot_date")).alias("month")).agg(
        F.avg("days_of_supply").alias("days_of_supply"),
        F.sum("stock_on_hand").alias("stock"),
        F.avg(F.col("overstock_flag").cast("int")).alias("overstock_rate"),
    )
    joined = months.join(monthly.select("month", "revenue"), "month")
    ahead = F.lead("revenue").over(by_date((), "month"))
    return joined.withColumn("next_revenue", ahead).where(
        "days_of_supply IS NOT NULL AND next_revenue IS NOT NULL"
    )


def leading_summary(indicator: DataFrame, risk: float = 1000.0) -> DataFrame:
    """Correlation with next month's revenue and the months in the risk zone."""
    zone = F.col("days_of_supply") >= risk
    return indicator.agg(
        F.count("*").alias("periods"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        safe_corr(F.col("days_of_supply"), F.col("next_revenue")).alias("correlation"),
        F.count_if(zone).alias("risk_months"),
        F.avg("next_revenue").alias("mean_next_revenue"),
        F.avg(F.when(zone, F.col("next_revenue"))).alias("mean_next_revenue_risk"),
    )


def inventory_features(months: DataFrame, days: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Last month's metrics and three-month means, put on the days of the month."""
    order = by_date((), "month")
    features = months.select(
        "month",
        *[F.lag(m).over(order).alias(f"{m}_lag_1") for m in metrics],
        *[rolled(m, 3, "mean", 1, 1, (), "month").alias(f"{m}_roll_mean_3") for m in metrics],
    )
    return month_to_day(days, features)


def constraint_master(daily: DataFrame, calendar: DataFrame, stock_months: DataFrame) -> DataFrame:
    """Days with revenue, orders, promotions and this and last month's stock-outs."""
    now = month_to_day(daily, stock_months.select("month", "stockout_rate", "mean_fill_rate"))
    before = stock_months.select(
        "month", F.col("stockout_rate").alias("stockout_rate_lag"), F.col("mean_fill_rate").alias("fill_rate_lag")
    )
    lagged = month_to_day(now, before, lag_months=1)
    return lagged.join(calendar.select("date", "has_promo", "active_promos"), "date", "left")


def constraint_matrix(master: DataFrame, side: Mapping[str, Column], volume: str = "orders") -> DataFrame:
    """Revenue of days by stock-out pressure and one other condition."""
    cut = master.agg(F.percentile("stockout_rate", F.lit(0.75)).alias("c")).scalar()
    (name, label), = side.items()
    marked = master.withColumn("_c", cut).withColumns(
        {
            name: label,
            "stockout_group": F.when(at_least(F.col("stockout_rate"), F.col("_c")), "high_stockout").otherwise(
                "low_stockout"
            ),
        }
    )
    return marked.groupBy(name, "stockout_group").agg(
        F.count("*").alias("days"),
        F.avg("revenue").alias("mean_revenue"),
        F.percentile("revenue", F.lit(0.5)).alias("median_revenue"),
        F.avg(volume).alias(f"mean_{volume}"),
        F.avg(ratio(F.col("revenue"), F.col(volume))).alias(f"revenue_per_{volume}"),
    )
