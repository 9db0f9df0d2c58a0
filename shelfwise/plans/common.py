"""Frames several query modules share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import month_start
from shelfwise.operators import timeseries as T
from shelfwise.operators.customers import customer_rollup
from shelfwise.operators.orders import order_level
from shelfwise.sources.star import Shop

MEASURES = ["revenue", "cogs", "orders", "quantity"]


def daily(shop: Shop) -> DataFrame:
    """Sales per calendar day without gaps."""
    fill = {"revenue": 0.0, "cogs": 0.0, "orders": 0, "quantity": 0.0}
    return T.densify(shop.sales, fill)


def monthly(shop: Shop) -> DataFrame:
    """Sales per month."""
    return shop.sales.groupBy(month_start(F.col("date")).alias("month")).agg(
        *[F.sum(c).alias(c) for c in MEASURES]
    )


def category_months(shop: Shop) -> DataFrame:
    """Revenue per category and month."""
    return shop.lines.groupBy("category", month_start(F.col("order_date")).alias("month")).agg(
        F.sum("revenue").alias("revenue")
    )


def web_daily(shop: Shop) -> DataFrame:
    """Daily traffic totals next to the purchases of the day."""
    traffic = shop.traffic.groupBy("date").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("unique_visitors").alias("unique_visitors"),
        F.sum("page_views").alias("page_views"),
        F.avg("bounce_rate").alias("bounce_rate"),
    )
    bought = shop.web_orders.groupBy(F.col("order_date").alias("date")).agg(
        F.count("*").alias("orders"), F.sum("order_value").alias("revenue")
    )
    return traffic.join(bought, "date", "left").fillna(0, ["orders", "revenue"])


def order_rows(shop: Shop) -> DataFrame:
    """Orders with item, payment and return totals."""
    return order_level(shop.orders, shop.items, shop.payments, shop.returns)


def rollup(shop: Shop) -> DataFrame:
    """Customer roll-up of the orders."""
    return customer_rollup(shop.orders)
