"""Regional revenue, behaviour, priorities and mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import percent_rank_over, quantiles
from shelfwise.functions.scalars import herfindahl, month_start, ratio
from shelfwise.operators.timeseries import by_date


def located(order_rows: DataFrame, customers: DataFrame, geography: DataFrame) -> DataFrame:
    """Orders with region and city of the customer; unknown places are kept."""
    homes = customers.select("customer_id", "zip").join(geography, "zip", "left")
    placed = order_rows.join(homes.drop("zip"), "customer_id", "left")
    return placed.withColumns(
        {c: F.coalesce(c, F.lit("Unknown")) for c in ("region", "city")}
    )


def revenue_by_place(orders: DataFrame, place: str) -> DataFrame:
    """Revenue, orders, order value, customers and shares per region or city."""
    sums = orders.groupBy(place).agg(
        F.sum("revenue").alias("revenue"),
        F.count("*").alias("orders"),
        F.avg("revenue").alias("aov"),
        F.count_distinct("customer_id").alias("customers"),
    )
    whole = lambda c: F.sum(c).over(Window.partitionBy())
    return sums.withColumns(
        {
            "revenue_share": ratio(F.col("revenue"), whole("revenue")),
            "order_share": F.col("orders") / whole("orders"),
            "revenue_per_customer": ratio(F.col("revenue"), F.col("customers")),
        }
    )


def regional_matrix(orders: DataFrame, delivered: DataFrame, place: str = "region") -> DataFrame:
    """Revenue, orders, returns and delivery per place with priority flag and score."""
    base = revenue_by_place(orders, place).join(
        quantiles(orders, "revenue", {"median_order": 0.5}, [place]), place
    )
    back = orders.groupBy(place).agg(
        ratio(F.count_if("is_returned"), F.count("*")).alias("return_rate"),
        ratio(F.coalesce(F.sum("refund"), F.lit(0.0)), F.sum("revenue")).alias("refund_ratio"),
    )
    times = delivered.groupBy(place).agg(
        F.avg("from_ship").alias("mean_days"),
        ratio(F.count_if("is_late"), F.count("*")).alias("late_ratio"),
    )
    matrix = base.join(back, place).join(times, place, "left")
    everything = Window.partitionBy()
    top = lambda c: F.col(c) >= F.percentile(c, F.lit(0.75)).over(everything)
    rank = lambda c: percent_rank_over(F.col(c))
    return matrix.withColumns(
        {
            "priority": (top("orders") & (top("mean_days") | top("late_ratio") | top("return_rate")))
            | (top("revenue") & top("mean_days")),
            "priority_score": rank("orders")
            + rank("revenue")
            + rank("mean_days")
            + rank("late_ratio")
            + rank("return_rate"),
        }
    )


def regional_monthly(orders: DataFrame, delivered: DataFrame, reviews: DataFrame, place: str = "region") -> DataFrame:
    """Month and region: revenue, return rate, delivery days and rating."""
    keys = [place, "month"]
    month = month_start(F.col("order_date")).alias("month")
    sales = orders.groupBy(place, month).agg(
        F.sum("revenue").alias("revenue"),
        F.count("*").alias("orders"),
        ratio(F.count_if("is_returned"), F.count("*")).alias("return_rate"),
    )
    times = delivered.groupBy(place, month).agg(F.avg("from_ship").alias("mean_days"))
    stars = reviews.groupBy("order_id").agg(
        F.sum("rating").alias("stars"), F.count("rating").alias("n")
    )
    rated = (
        orders.select("order_id", place, "order_date")
        .join(stars, "order_id")
        .groupBy(place, month)
        .agg(ratio(F.sum("stars"), F.sum("n")).alias("mean_rating"))
    )
    return sales.join(times, keys, "left").join(rated, keys, "left")


def region_mix(orders: DataFrame, places: Sequence[str], high_risk: DataFrame | None = None) -> DataFrame:
    """Per day: top share, HHI and top orders of each place level, and last day's values."""
    out = orders.groupBy(F.col("order_date").alias("date")).agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("orders")
    )
    for place in places:
        cells = orders.groupBy(F.col("order_date").alias("date"), place).agg(
            F.sum("revenue").alias("r"), F.count("*").alias("n"), F.avg("revenue").alias("a")
        )
        day = Window.partitionBy("date")
        shares = cells.withColumns(
            {
                "s": ratio(F.col("r"), F.sum("r").over(day)),
                "rich": F.col("a") >= F.percentile("a", F.lit(0.75)).over(day),
            }
        )
        if high_risk is not None and place in high_risk.columns:
            marked = high_risk.select(place, F.lit(True).alias("risky"))
            shares = shares.join(marked, place, "left")
        else:
            shares = shares.withColumn("risky", F.lit(None).cast("boolean"))
        stats = shares.groupBy("date").agg(
            F.max("s").alias(f"top_{place}_share"),
            herfindahl(F.col("s")).alias(f"{place}_hhi"),
            F.max("n").alias(f"top_{place}_orders"),
            F.coalesce(F.sum(F.when(F.col("rich"), F.col("s"))), F.lit(0.0)).alias(f"high_aov_{place}_share"),
            ratio(
                F.coalesce(F.sum(F.when(F.col("risky"), F.col("n"))), F.lit(0)), F.sum("n")
            ).alias(f"high_risk_{place}_share"),
        )
        out = out.join(stats, "date", "left")
    names = [c for c in out.columns if c not in ("date", "revenue", "orders")]
    order = by_date()
    return out.withColumns({f"{n}_lag_1": F.lag(n).over(order) for n in names})
