"""Shared helpers of the order, delivery and payment analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordered import quantiles
from shelfwise.functions.scalars import bands


def quantile_groups(df: DataFrame, value: str, cuts: Sequence[tuple[float, str]], last: str, name: str) -> DataFrame:
    """Label rows by exact quantile edges of ``value``."""
    edges = quantiles(df, value, {f"q{i}": p for i, (p, _) in enumerate(cuts)})
    placed = df.withColumn("_q", edges.select(F.struct("*")).scalar())
    labels = [(F.col(f"_q.q{i}"), label) for i, (_, label) in enumerate(cuts)]
    return placed.withColumn(name, bands(F.col(value), labels, last)).drop("_q")
