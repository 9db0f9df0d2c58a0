"""Joins that keep fact rows intact: de-duplicated dimensions, origins, intervals.

Sides are never hinted; Catalyst broadcasts a side only when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and AQE splits skewed sort-merge
partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import month_start


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row per key in ``order`` (all other columns by default)."""
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in (order or rest) if c in rest]
    ranked = F.min(F.struct(*first, *[c for c in rest if c not in first]))
    return df.groupBy(*keys).agg(ranked.alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in rest])


def lookup_join(fact: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Left join with a de-duplicated dimension: fact rows are never multiplied."""
    return fact.join(one_per_key(dim, keys, order), list(keys), "left")


def with_origin(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Join that says whether a row came from both sides or from one."""
    a = left.withColumn("_in_left", F.lit(True))
    b = right.withColumn("_in_right", F.lit(True))
    origin = (
        F.when(F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull(), "both")
        .when(F.col("_in_left").isNotNull(), "left_only")
        .otherwise("right_only")
    )
    return a.join(b, list(keys), how).withColumn("origin", origin).drop("_in_left", "_in_right")


def align_series(series: Mapping[str, DataFrame], key: str = "date") -> DataFrame:
    """Full outer join of several daily or monthly series, one column set per name."""
    out = None
    for name, df in series.items():
        renamed = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = renamed if out is None else out.join(renamed, key, "full_outer")
    return out


def star_flatten(items: DataFrame, orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Line-level table with order, product and customer attributes; lines are kept."""
    return (
        items.join(orders, "order_id", "left")
        .join(products, "product_id", "left")
        .join(customers, "customer_id", "left")
    )


def aggregate_then_join(base: DataFrame, detail: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Left join with details totalled per key first, so rows do not fan out."""
    totals = detail.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return base.join(totals, list(keys), "left")


def match_returns(items: DataFrame, returns: DataFrame, match: str = "line") -> DataFrame:
    """Lines totalled with their returns, by order and product or by order only."""
    keys = ["order_id", "product_id"] if match == "line" else ["order_id"]
    ordered = items.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")
    )
    return aggregate_then_join(
        ordered,
        returns,
        keys,
        {"returned_quantity": F.sum("return_quantity"), "refund": F.sum("refund_amount")},
    ).withColumn("is_returned", F.col("returned_quantity").isNotNull())


def expand_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day of each inclusive interval; null and inverted ranges vanish."""
    days = F.sequence(start, end, F.expr("interval 1 day"))
    return (
        df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        .withColumn("date", F.explode(days))
    )


def month_to_day(days: DataFrame, months: DataFrame, date: str = "date", lag_months: int = 0) -> DataFrame:
    """Put month rows on the days of the month (or ``lag_months`` later)."""
    key = F.add_months(month_start(F.col("month")), lag_months).alias("_month")
    moved = months.select(key, *[c for c in months.columns if c != "month"])
    keyed = days.withColumn("_month", month_start(F.col(date)))
    return keyed.join(moved, "_month", "left").drop("_month")


def near_days(left: DataFrame, right: DataFrame, days: int, keep: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (or without) a ``right`` date at most ``days`` away.

    Right dates are copied into every day of their neighbourhood, so the join
    stays an equi join whose fan-out is ``2 * days + 1`` per distinct date.
    """
    around = F.sequence(F.date_sub("date", days), F.date_add("date", days), F.expr("interval 1 day"))
    reach = right.select("date").distinct().select(F.explode(around).alias("date")).distinct()
    return left.join(reach, "date", keep)


def at_offsets(df: DataFrame, value: str, offsets: Sequence[int], date: str = "date") -> DataFrame:
    """Value of a series exactly ``k`` calendar days later, for every ``k``."""
    out = df
    for k in offsets:
        later = df.select(F.date_sub(date, k).alias(date), F.col(value).alias(f"{value}_t{k:+d}"))
        out = out.join(later, date, "left")
    return out


def fill_from(df: DataFrame, dim: DataFrame, keys: Sequence[str], columns: Sequence[str], key: str) -> DataFrame:
    """Attributes of the first key among ``keys`` that is present."""
    keyed = df.withColumn(key, F.coalesce(*[F.col(k) for k in keys]))
    joined = keyed.join(one_per_key(dim.select(key, *columns), [key]), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in columns})


def with_grid(df: DataFrame, grid: Sequence[Mapping[str, object]], name: str = "point") -> DataFrame:
    """Every row at every point of a small literal parameter grid."""
    points = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in g.items()]) for g in grid])
    exploded = df.withColumn(name, F.explode(points))
    return exploded.select(*df.columns, f"{name}.*")
