"""Named queries: a Spark plan, its output columns and an independent SQL check."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.star import Shop

Build = Callable[[Shop], DataFrame]

# i integer, d four decimals (two from 1000 up), e six decimals, t date, s text, b flag
SPARK_TYPES = {"i": "bigint", "d": "double", "e": "double", "t": "date", "s": "string", "b": "boolean"}
SQL_TYPES = {"i": "BIGINT", "d": "DOUBLE", "e": "DOUBLE", "t": "DATE", "s": "VARCHAR", "b": "BOOLEAN"}
LARGE = 1000
# Means of money fall exactly half-way between two roundings, where the order of a
# float sum decides. Moving every value by a fifth of the last place avoids that
# and leaves values with few enough decimals as they are.
NUDGE = 0.1827


@dataclass(frozen=True)
class Query:
    """One registered query."""

    build: Build
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Shop(spark, folder))
        return df.select(*[_spark_column(n, t) for n, t in self.columns])

    def check(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(_sql_column(n, t) for n, t in self.columns)
        return f"{_with(self.sql)} SELECT {shown} FROM ({self.sql}) AS answer"


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a plan under ``name``; ``columns`` reads ``year:i revenue:d ...``."""
    pairs = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, pairs, sql)
        return build

    return register


def view(name: str, sql: str) -> None:
    """Name a SQL building block for the checks."""
    VIEWS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"\bx_\w+", sql))
    return [name for name in VIEWS if name in words]


def _with(sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in _needs(VIEWS[name]):
            if inner != name:
                visit(inner)
        if name not in order:
            order.append(name)

    for name in _needs(sql):
        visit(name)
    if not order:
        return ""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


def _spark_column(name: str, kind: str) -> Column:
    value = F.col(name).cast(SPARK_TYPES[kind])
    rounded = lambda n: F.round(value + NUDGE / 10**n, n)
    if kind == "d":
        value = F.when(F.abs(value) >= LARGE, rounded(2)).otherwise(rounded(4))
    elif kind == "e":
        value = rounded(6)
    return value.alias(name)


def _sql_column(name: str, kind: str) -> str:
    value = f'CAST("{name}" AS {SQL_TYPES[kind]})'
    rounded = lambda n: f"round({value} + {NUDGE / 10**n:.12f}, {n}) + 0.0"
    if kind == "d":
        value = f"CASE WHEN abs({value}) >= {LARGE} THEN {rounded(2)} ELSE {rounded(4)} END"
    elif kind == "e":
        value = rounded(6)
    return f'{value} AS "{name}"'
