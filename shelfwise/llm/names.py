"""Tables under names of our own, so that a user's column never meets one that is used inside."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places."""
    return df.toDF(*[f"column{i}" for i in range(len(df.columns))])


def of(df: DataFrame, name: str) -> Column:
    """The column of :func:`numbered` that ``df`` calls ``name``."""
    return F.col(f"column{df.columns.index(name)}")


def named(df: DataFrame, without: Collection[str] = ()) -> list[Column]:
    """The columns of :func:`numbered` under their own names, but for those in ``without``, in any case."""
    return [F.col(f"column{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in without]
