"""Tables behind report charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def waterfall(steps: DataFrame, position: str, label: str, value: str) -> DataFrame:
    """Bottom, height and end level of a waterfall: start, changes, total."""
    order = Window.orderBy(position)
    end = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    bars = steps.select(
        F.col(position).cast("int").alias("position"),
        F.col(label).alias("label"),
        (end - F.col(value)).alias("bottom"),
        F.col(value).alias("height"),
        end.alias("end_level"),
    )
    total = steps.agg(
        (F.max(position) + 1).cast("int").alias("position"),
        F.lit("total").alias("label"),
        F.lit(0.0).alias("bottom"),
        F.sum(value).alias("height"),
        F.sum(value).alias("end_level"),
    )
    return bars.unionByName(total)
