"""Order-level tables, order value, baskets and revenue decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import null_safe_join, percent_rank_over, quantiles
from shelfwise.functions.scalars import at_least, change, clip, ratio
from shelfwise.operators.aggregate import correlations
from shelfwise.operators.joins import aggregate_then_join
from shelfwise.operators.timeseries import densify


def order_level(orders: DataFrame, items: DataFrame, payments: DataFrame | None = None, returns: DataFrame | None = None) -> DataFrame:
    """One row per order; details are totalled before they are joined."""
    out = aggregate_then_join(
        orders,
        items,
        ["order_id"],
        {
            "revenue": F.sum("revenue"),
            "quantity": F.sum("quantity"),
            "lines": F.count("*"),
            "products": F.count_distinct("product_id"),
            "has_promo": F.max("promo_used"),
        },
    )
    if payments is not None:
        out = aggregate_then_join(
            out,
            payments,
            ["order_id"],
            {
                "payment_value": F.sum("payment_value"),
                "installments": F.max("installments"),
            },
        )
    if returns is not None:
        out = aggregate_then_join(
            out,
            returns,
            ["order_id"],
            {"returned_quantity": F.sum("return_quantity"), "refund": F.sum("refund_amount")},
        ).withColumn("is_returned", F.col("returned_quantity").isNotNull())
    return out


def order_daily(order_rows: DataFrame) -> DataFrame:
    """Orders, revenue and order value per day without gaps."""
    daily = order_rows.groupBy(F.col("order_date").alias("date")).agg(
        F.count("*").alias("orders"), F.sum("revenue").alias("revenue")
    )
    dense = densify(daily, {"orders": 0, "revenue": 0.0})
    return dense.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))


def monthly_alignment(monthly: DataFrame, limit: float = 0.05, aov_limit: float = 0.03) -> DataFrame:
    """Monthly change of orders, revenue and order value with two pattern labels."""
    order = Window.orderBy("month")
    base = monthly.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))
    moved = base.withColumns(
        {f"{c}_change": change(F.col(c), F.lag(c).over(order)) for c in ("orders", "revenue", "aov")}
    )
    o, r, a = F.col("orders_change"), F.col("revenue_change"), F.col("aov_change")
    return moved.withColumns(
        {
            "pattern": F.when(
                (o > limit) & (r <= limit), "orders increased but revenue did not increase much"
            )
            .when((r > limit) & (F.abs(o) <= limit), "revenue increased despite stable order count")
            .when((o > limit) & (r > limit), "both orders and revenue increased")
            .when((o < -limit) & (r < -limit), "both orders and revenue decreased")
            .otherwise("mixed or stable"),
            "alignment": F.when(
                (r > aov_limit) & (o > a), "revenue increase aligned more with order count"
            )
            .when((r > aov_limit) & (a > o), "revenue increase aligned more with AOV")
            .when((r < -aov_limit) & (o < a), "revenue decrease aligned more with order count drop")
            .when((r < -aov_limit) & (a < o), "revenue decrease aligned more with AOV drop")
            .otherwise("mixed or stable"),
        }
    )


def high_day_drivers(daily: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` best revenue days classed by percentile ranks of orders and order value."""
    ranked = daily.withColumns(
        {
            "orders_rank": percent_rank_over(F.col("orders")),
            "aov_rank": percent_rank_over(F.col("aov")),
        }
    )
    many, rich = F.col("orders_rank"), F.col("aov_rank")
    label = (
        F.when(many.isNull() | rich.isNull(), "unclear/missing")
        .when((many >= 0.9) & (rich >= 0.9), "both high order count and high AOV")
        .when((many >= 0.9) & (rich < 0.75), "unusually high order count")
        .when((rich >= 0.9) & (many < 0.75), "unusually high AOV")
        .when(many >= 0.9, "order count leaning")
        .when(rich >= 0.9, "AOV leaning")
        .otherwise("unclear/mixed")
    )
    return ranked.orderBy(F.desc("revenue"), "date").limit(n).withColumn("driver", label)


def aov_by(order_rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Orders, revenue, mean and median order value per group."""
    known = order_rows.where("revenue IS NOT NULL")
    sums = known.groupBy(*groups).agg(
        F.count("*").alias("orders"),
        F.sum("revenue").alias("revenue"),
        F.avg("revenue").alias("aov"),
    )
    return null_safe_join(sums, quantiles(known, "revenue", {"median_aov": 0.5}, groups), list(groups), "left")


def aov_anomalies(daily: DataFrame) -> DataFrame:
    """Days whose order value is above max(P99, Q3 + 1.5 IQR), below the mirror, or |z| >= 3."""
    stats = daily.agg(
        F.avg("aov").alias("mean"),
        F.stddev_samp("aov").alias("std"),
        *[F.percentile("aov", F.lit(p)).alias(n) for n, p in {"q1": 0.25, "q3": 0.75, "p01": 0.01, "p99": 0.99}.items()],
    ).select(F.struct("*")).scalar()
    s = lambda name: F.col(f"_s.{name}")
    iqr = s("q3") - s("q1")
    high = F.greatest(s("p99"), s("q3") + 1.5 * iqr)
    low = F.least(s("p01"), s("q1") - 1.5 * iqr)
    scored = daily.withColumn("_s", stats).withColumn(
        "z", ratio(F.col("aov") - s("mean"), s("std"))
    )
    up = (F.col("aov") >= high) | (F.col("z") >= 3)
    down = (F.col("aov") <= low) | (F.col("z") <= -3)
    return (
        scored.where(up | down)
        .withColumn("direction", F.when(up, "high").otherwise("low"))
        .drop("_s")
    )


def large_threshold() -> Column:
    """Baskets above max(P99, Q3 + 1.5 IQR) are large."""
    q1, q3 = F.col("_m.p25"), F.col("_m.p75")
    return F.greatest(F.col("_m.p99"), q3 + 1.5 * (q3 - q1))


BASKET_MARKS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def basket_summary(order_rows: DataFrame, metric: str = "quantity") -> DataFrame:
    """Distribution of basket sizes and the large-basket threshold."""
    known = order_rows.where(F.col(metric).isNotNull())
    marks = quantiles(known, metric, BASKET_MARKS)
    sums = known.agg(
        F.count("*").alias("orders"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
        F.max(metric).alias("high"),
        F.avg("products").alias("mean_products"),
        F.avg("lines").alias("mean_lines"),
    )
    marked = sums.withColumn("_m", marks.select(F.struct("*")).scalar())
    return marked.withColumn("large_threshold", large_threshold()).select("*", "_m.*").drop("_m")


def large_baskets(order_rows: DataFrame, metric: str = "quantity") -> DataFrame:
    """Orders with their large-basket flag and size capped at P99."""
    known = order_rows.where(F.col(metric).isNotNull())
    marks = quantiles(known, metric, BASKET_MARKS)
    return known.withColumn("_m", marks.select(F.struct("*")).scalar()).withColumns(
        {
            "is_large": at_least(F.col(metric), large_threshold()),
            "capped": clip(F.col(metric), None, F.col("_m.p99")),
        }
    ).drop("_m")


def basket_by(order_rows: DataFrame, groups: Sequence[str | Column], metric: str = "quantity") -> DataFrame:
    """Basket size and large-basket share per group."""
    return large_baskets(order_rows, metric).groupBy(*groups).agg(
        F.count("*").alias("orders"),
        F.avg(metric).alias("mean_size"),
        F.avg("capped").alias("mean_capped"),
        F.avg("lines").alias("mean_lines"),
        ratio(F.count_if("is_large"), F.count("*")).alias("large_share"),
    )


def category_baskets(lines: DataFrame) -> DataFrame:
    """Lines, quantity and revenue per order and category."""
    return lines.groupBy("order_id", "category").agg(
        F.count("*").alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
    )


def revenue_decomposition(periods: DataFrame, date: str = "month") -> DataFrame:
    """Revenue change split into order effect, order-value effect and interaction."""
    order = Window.orderBy(date)
    base = periods.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))
    d = lambda c: F.col(c) - F.lag(c).over(order)
    moved = base.withColumns(
        {
            "d_revenue": d("revenue"),
            "d_orders": d("orders"),
            "d_aov": d("aov"),
            "_orders": F.lag("orders").over(order),
            "_aov": F.lag("aov").over(order),
        }
    ).where("d_revenue IS NOT NULL")
    parts = moved.withColumns(
        {
            "order_effect": F.col("d_orders") * F.col("_aov"),
            "aov_effect": F.col("d_aov") * F.col("_orders"),
            "interaction": F.col("d_orders") * F.col("d_aov"),
        }
    )
    size = lambda c: F.abs(c)
    top = F.greatest(size("order_effect"), size("aov_effect"), size("interaction"))
    driver = (
        F.when(size("order_effect") == top, "order_effect")
        .when(size("aov_effect") == top, "aov_effect")
        .otherwise("interaction")
    )
    return parts.withColumn("dominant", driver).drop("_orders", "_aov")


def driver_correlations(daily: DataFrame) -> DataFrame:
    """Correlation of revenue with orders and order value: overall, per year, top days."""
    pairs = [("revenue", "orders"), ("revenue", "aov")]
    cut = daily.agg(F.percentile("revenue", F.lit(0.9)).alias("c")).scalar()
    parts = {
        "overall": daily.withColumn("scope", F.lit("overall")),
        "year": daily.withColumn("scope", F.year("date").cast("string")),
        "month": daily.withColumn("scope", F.concat(F.lit("month_"), F.month("date").cast("string"))),
        "high_revenue": daily.withColumn("_c", cut)
        .where(at_least(F.col("revenue"), F.col("_c")))
        .withColumn("scope", F.lit("high_revenue_days")),
    }
    table = None
    for df in parts.values():
        rows = correlations(df.select("scope", "revenue", "orders", "aov"), pairs, ["scope"])
        table = rows if table is None else table.unionByName(rows)
    wide = table.groupBy("scope").agg(
        F.max(F.when(F.col("y") == "orders", F.col("correlation"))).alias("orders_corr"),
        F.max(F.when(F.col("y") == "aov", F.col("correlation"))).alias("aov_corr"),
    )
    return wide.withColumn(
        "dominant",
        F.when(F.abs("orders_corr") >= F.abs("aov_corr"), "orders").otherwise("aov"),
    )


def peak_drivers(daily: DataFrame, top: int = 3) -> DataFrame:
    """Months of the year ranked by revenue, orders and order value, with a class."""
    months = daily.groupBy(F.month("date").alias("month")).agg(
        F.avg("revenue").alias("revenue"), F.avg("orders").alias("orders"), F.avg("aov").alias("aov")
    )
    rank = lambda c: F.dense_rank().over(Window.orderBy(F.desc(c)))
    ranked = months.withColumns({f"{c}_rank": rank(c) for c in ("revenue", "orders", "aov")})
    many, rich = F.col("orders_rank") <= top, F.col("aov_rank") <= top
    label = (
        F.when(many & rich, "both")
        .when(many, "high_order_volume")
        .when(rich, "high_AOV")
        .otherwise("mixed")
    )
    return ranked.withColumn("peak_class", label)
