"""Projections, filters and derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import is_cancelled, is_completed, is_returned, ratio


def line_financials(items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, cost, profit, promotion flag and sold-at-a-loss flag per line."""
    revenue = F.col("quantity") * F.col("unit_price")
    cost = F.col("quantity") * F.col("cogs")
    return (
        items.join(products, "product_id")
        .withColumns({"line_revenue": revenue, "line_cost": cost})
        .withColumns(
            {
                "line_profit": F.col("line_revenue") - F.col("line_cost"),
                "has_promo": F.col("promo_id").isNotNull(),
                "sold_at_loss": F.col("unit_price") < F.col("cogs"),
            }
        )
    )


def gross_margin(df: DataFrame, profit: str = "profit", revenue: str = "revenue") -> DataFrame:
    """Profit over revenue with a zero guard."""
    return df.withColumn("gross_margin", ratio(F.col(profit), F.col(revenue)))


def weighted_margin(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Margin of summed profit and revenue per group."""
    return df.groupBy(*keys).agg(ratio(F.sum("profit"), F.sum("revenue")).alias("margin"))


def promo_used(items: DataFrame) -> DataFrame:
    """Any sign of a promotion on a line and its first promotion id."""
    primary = F.coalesce("promo_id", "promo_id_2")
    return items.withColumns(
        {
            "primary_promo_id": primary,
            "promo_line": primary.isNotNull() | (F.coalesce("discount_amount", F.lit(0)) > 0),
        }
    )


def promo_id_long(items: DataFrame, columns: Sequence[str] = ("promo_id", "promo_id_2")) -> DataFrame:
    """One row per line and promotion id, with the column it came from."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("promo_source_column"), F.col(c).alias("id")) for c in columns]
    )
    kept = F.filter(entries, lambda e: e["id"].isNotNull())
    rest = [c for c in items.columns if c not in columns]
    return items.select(*rest, F.explode(kept).alias("e")).select(
        *rest, "e.promo_source_column", F.col("e.id").alias("promo_id")
    )


def aov_and_cost_ratio(daily: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Order value and cost ratio per day, gaps filled from the past, then the future."""
    back = Window.partitionBy(*series).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*series).orderBy("date").rowsBetween(0, Window.unboundedFollowing)

    def filled(name: str):
        return F.coalesce(
            F.last(name, ignorenulls=True).over(back), F.first(name, ignorenulls=True).over(ahead)
        )

    return daily.withColumns(
        {
            "aov": ratio(F.col("revenue"), F.col("orders")),
            "cogs_ratio": ratio(F.col("cogs"), F.col("revenue")),
        }
    ).withColumns({"aov": filled("aov"), "cogs_ratio": filled("cogs_ratio")})


def status_flags(orders: DataFrame) -> DataFrame:
    """Completed, cancelled and returned flags from the order status text."""
    status = F.col("order_status")
    return orders.withColumns(
        {
            "is_completed": is_completed(status),
            "is_cancelled": is_cancelled(status),
            "is_returned": is_returned(status),
        }
    )


def without_excluded(orders: DataFrame) -> DataFrame:
    """Orders that count for order value: neither cancelled nor returned."""
    flagged = status_flags(orders)
    return flagged.where(~F.col("is_cancelled") & ~F.col("is_returned"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def point_lookup(df: DataFrame, **equals: object) -> DataFrame:
    """Rows that match the given column values; filters reach the scan."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def zscores(df: DataFrame, value: str, population: bool = False, name: str = "z") -> DataFrame:
    """Standard scores over the whole frame, null when there is no spread."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(F.avg(value).alias("mean"), spread(value).alias("std"))
    stats = stats.select(F.struct("mean", "std")).scalar()
    return df.withColumn("_s", stats).withColumn(
        name, ratio(F.col(value) - F.col("_s.mean"), F.col("_s.std"))
    ).drop("_s")
