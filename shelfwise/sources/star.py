"""Retail-shaped frames over a star schema of Parquet tables.

The operators expect retail names (``order_id``, ``revenue``, ...). ``Shop`` maps
the star tables to them and keeps the derived frames lazy, so a query only scans
the columns it uses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import month_start, ratio
from shelfwise.sources.session import bounded_tasks, prepare

COGS_SHARE = 0.6  # unit cost as a share of the list price


class Shop:
    """Lazy retail frames for one folder of star tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = bounded_tasks(prepare(spark))
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        """One raw star table."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_totalprice").alias("order_value"),
        )

    @cached_property
    def items(self) -> DataFrame:
        price, rate = F.col("l_extendedprice"), F.col("l_discount")
        promo = F.concat(F.lit("PROMO-"), (F.col("l_partkey") % 50 + 1).cast("string"))
        second = F.concat(F.lit("PROMO-"), (F.col("l_suppkey") % 60 + 1).cast("string"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            ratio(price, F.col("l_quantity")).alias("unit_price"),
            price.alias("gross"),
            rate.alias("discount_rate"),
            (price * rate).alias("discount_amount"),
            (price * (1 - rate)).alias("revenue"),
            (price * F.col("l_tax")).alias("shipping_fee"),
            F.when(rate >= 0.05, promo).alias("promo_id"),
            F.when((rate > 0) & (F.col("l_tax") >= 0.08), second).alias("promo_id_2"),
            (rate > 0).alias("promo_used"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_linestatus").alias("line_status"),
            F.col("l_tax").alias("tax"),
            F.to_date("l_shipdate").alias("ship_date"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("segment"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_retailprice") * COGS_SHARE).alias("cogs"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_nationkey").alias("zip"),
            F.col("c_mktsegment").alias("channel"),
            F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def geography(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("zip"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("city"),
        )

    @cached_property
    def sold(self) -> DataFrame:
        """Item lines with the date, customer and status of their order."""
        return self.items.join(self.orders, "order_id")

    @cached_property
    def lines(self) -> DataFrame:
        """Sold lines with product attributes, cost and profit."""
        cost = F.col("quantity") * F.col("cogs")
        return self.sold.join(self.products, "product_id").withColumns(
            {"cost": cost, "profit": F.col("revenue") - cost}
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Daily revenue, cost of goods and orders.

        Lines are totalled per order first: the join then moves one row per order, and
        orders can be counted without a distinct count.
        """
        cost = F.col("quantity") * F.col("cogs")
        totals = (
            self.items.join(self.products.select("product_id", "cogs"), "product_id")
            .groupBy("order_id")
            .agg(
                F.sum("revenue").alias("revenue"),
                F.sum(cost).alias("cogs"),
                F.sum("quantity").alias("quantity"),
            )
        )
        dated = totals.join(self.orders.select("order_id", "order_date"), "order_id")
        return dated.groupBy(F.col("order_date").alias("date")).agg(
            F.sum("revenue").alias("revenue"),
            F.sum("cogs").alias("cogs"),
            F.count("*").alias("orders"),
            F.sum("quantity").alias("quantity"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.orders.select(
            "order_id",
            "payment_method",
            F.col("order_value").alias("payment_value"),
            (F.col("order_id") % 12 + 1).cast("int").alias("installments"),
        )

    @cached_property
    def shipments(self) -> DataFrame:
        """One row per order: first and last ship day, fee, sometimes an estimate."""
        first, last = F.min("ship_date"), F.max("ship_date")
        return (
            self.items.groupBy("order_id")
            .agg(
                first.alias("ship_date"),
                last.alias("delivery_date"),
                F.sum("shipping_fee").alias("shipping_fee"),
            )
            .withColumn(
                "estimated_delivery_date",
                F.when(F.col("order_id") % 3 != 0, F.date_add("ship_date", 900)),
            )
        )

    @cached_property
    def returns(self) -> DataFrame:
        tax, status = F.col("tax"), F.col("line_status")
        reason = (
            F.when((status == "O") & (tax < 0.03), "Too Small")
            .when((status == "O") & (tax < 0.06), "changed-mind")
            .when(status == "O", "late delivery")
            .when(tax < 0.04, "Damaged")
            .otherwise("not as described")
        )
        return self.items.where(F.col("return_flag") == "R").select(
            "order_id",
            "product_id",
            F.col("ship_date").alias("return_date"),
            reason.alias("return_reason"),
            F.col("quantity").alias("return_quantity"),
            F.col("revenue").alias("refund_amount"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self.items.where(F.col("line_status") == "F").select(
            "order_id",
            "product_id",
            F.col("ship_date").alias("review_date"),
            ((F.col("product_id") + F.col("order_id")) % 5 + 1).cast("int").alias("rating"),
        )

    @cached_property
    def traffic(self) -> DataFrame:
        """Web traffic per day and source from the event log."""
        return (
            self.table("events")
            .where(F.col("event_type") != "purchase")
            .groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("traffic_source"))
            .agg(
                F.count("*").alias("sessions"),
                F.count_distinct("user_id").alias("unique_visitors"),
                F.sum(F.col("event_id") % 4 + 1).alias("page_views"),
                F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)).alias("bounce_rate"),
                F.avg("value").alias("avg_session_duration_sec"),
            )
        )

    @cached_property
    def web_orders(self) -> DataFrame:
        """Purchases from the event log."""
        return (
            self.table("events")
            .where(F.col("event_type") == "purchase")
            .select(
                F.col("event_id").alias("order_id"),
                F.to_date("ts").alias("order_date"),
                F.col("user_id").alias("customer_id"),
                F.col("value").alias("order_value"),
                F.when(F.col("event_id") % 5 == 0, "cancelled")
                .when(F.col("event_id") % 5 == 1, "paid")
                .otherwise("delivered")
                .alias("order_status"),
            )
        )

    @cached_property
    def promotions(self) -> DataFrame:
        """Promotion calendar read off the discounted lines."""
        number = F.col("product_id") % 50 + 1
        top = F.max(F.struct("gross", "order_date", "category"))
        return (
            self.lines.where(F.col("promo_id").isNotNull())
            .groupBy("promo_id")
            .agg(
                F.max(number).alias("number"),
                top.alias("top"),
                F.avg("discount_rate").alias("rate"),
            )
            .select(
                "promo_id",
                F.when(F.col("number") % 10 == 0, "fixed").otherwise("percentage").alias("promo_type"),
                F.when(F.col("number") % 10 == 0, F.lit(50.0))
                .otherwise(F.round(F.col("rate") * 100, 1))
                .alias("discount_value"),
                F.col("top.order_date").alias("start_date"),
                F.date_add("top.order_date", (F.col("number") * 3 + 5).cast("int")).alias("end_date"),
                F.when(F.col("number") % 5 == 0, F.col("top.category")).alias("applicable_category"),
            )
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """Month-end product snapshots: received by ship month, sold by order month."""
        got = self.items.select(
            "product_id",
            month_start(F.col("ship_date")).alias("month"),
            F.col("quantity").alias("received"),
            F.lit(0.0).alias("units_sold"),
        )
        gone = self.sold.select(
            "product_id",
            month_start(F.col("order_date")).alias("month"),
            F.lit(0.0).alias("received"),
            F.col("quantity").alias("units_sold"),
        )
        months = (
            got.unionByName(gone)
            .groupBy("product_id", "month")
            .agg(F.sum("received").alias("received"), F.sum("units_sold").alias("units_sold"))
        )
        so_far = Window.partitionBy("product_id").orderBy("month").rowsBetween(
            Window.unboundedPreceding, 0
        )
        stock = F.greatest(
            F.sum(F.col("received") - F.col("units_sold")).over(so_far), F.lit(0.0)
        )
        sold, shelf = F.col("units_sold"), F.col("stock_on_hand")
        return (
            months.withColumn("stock_on_hand", stock)
            .withColumns(
                {
                    "snapshot_date": F.last_day("month"),
                    "stockout_flag": shelf <= 0,
                    "stockout_days": F.when(shelf <= 0, F.col("product_id") % 20 + 1)
                    .otherwise(0)
                    .cast("int"),
                    "fill_rate": F.least(F.lit(1.0), ratio(shelf + F.col("received"), sold)),
                    "days_of_supply": ratio(shelf * 30, sold),
                    "overstock_flag": shelf > sold * 3,
                    "reorder_flag": shelf < sold,
                    "reorder_quantity": F.greatest(sold - shelf, F.lit(0.0)),
                    "sell_through_rate": ratio(sold, sold + shelf),
                }
            )
            .join(self.products.select("product_id", "category", "segment"), "product_id")
        )


def literal_day(text: str) -> Column:
    """Date literal."""
    return F.lit(text).cast("date")
