"""Many models fitted in one pass, trees as arrays, and forecasts that feed on their own values.

Linear models need only sums of products: one aggregate over rows marked with their model gives the Gram matrices of all
models at once, and each is solved from its few sums. Trees are fitted by Spark and flattened. Either kind travels with
the task that forecasts a series day by day.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.aggregate import gram, square
from shelfwise.operators.forecast import (
    FEATURES,
    LAGS,
    MISSING,
    SERIES,
    WINDOWS,
    annual_growth,
    calendar_features,
    fit_gbt,
    history_features,
    least_values,
    seasonal_baseline,
    with_row,
)
from shelfwise.operators.joins import with_grid

#: Strength of the ridge, on standardised features and targets.
PENALTY = 0.05
REACH = max(*LAGS, *WINDOWS)


# --- linear models ------------------------------------------------------------------

def ridge(sums: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept from the sums of products of (1, features, target)."""
    n = sums[0, 0]
    means = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(means, means)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = spread[:-1] > 1e-9 * (1 + np.abs(means[:-1]))  # constant features get no weight
    weights = np.zeros(len(live))
    if live.any() and spread[-1] > 0:
        x = spread[:-1][live]
        corr = cov[:-1, :-1][np.ix_(live, live)] / np.outer(x, x)
        solved = np.linalg.solve(corr + penalty * np.eye(len(x)), cov[:-1, -1][live] / (x * spread[-1]))
        weights[live] = solved * spread[-1] / x
    return weights, float(means[-1] - weights @ means[:-1])


def log_value(column: Column) -> Column:
    """The logarithm that models see: of one more, never of less than zero; unknown values count as zero."""
    known = F.when(column.isNotNull() & ~F.isnan(column.cast("double")), column.cast("double")).otherwise(0.0)
    return F.log1p(F.greatest(known, F.lit(0.0)))


def training_rows(features: DataFrame, keys: Sequence[str] = (), lists: Mapping[str, Sequence[str]] = FEATURES) -> DataFrame:
    """Per row of features and per model its logarithms: keys, model, date, x (array), y. Rows without a target go."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.array(*[log_value(F.col(c)) for c in columns]).alias("x"),
                     F.when(F.col(name).isNotNull(), log_value(F.col(name))).alias("y"))
            for name, columns in lists.items()
        ]
    )
    return features.select(*keys, "date", F.explode(entries).alias("e")).select(*keys, "date", "e.*").where("y IS NOT NULL")


def fit_linear(rows: DataFrame, keys: Sequence[str] = (), penalty: float = PENALTY) -> DataFrame:
    """One ridge model per ``keys`` and model name, all from one aggregate: keys, model, n, weights, intercept."""
    by = [*keys, "model"]
    sums = gram(rows, by, F.concat(F.array(F.lit(1.0)), "x", F.array("y")))
    schema = T.StructType(
        [*[f for f in rows.schema.fields if f.name in by], T.StructField("n", T.LongType()),
         T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType())]
    )
    order = [f.name for f in schema.fields[:-3]]

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        matrix = square(part["place"].to_numpy(), part["total"].to_numpy())
        weights, intercept = ridge(matrix, penalty)
        known = dict(zip(by, key))
        return pd.DataFrame([[*[known[k] for k in order], round(matrix[0, 0]), weights.tolist(), intercept]], columns=schema.names)

    return sums.groupBy(*by).applyInPandas(solve, schema)


def gradients(rows: DataFrame, models: DataFrame, keys: Sequence[str] = (), penalty: float = PENALTY) -> DataFrame:
    """How far each model is from the least penalised error: the mean residual and the largest entry of the penalised
    gradient over all its rows, in units of the standardised data. Both are zero at the optimum."""
    by = [*keys, "model"]
    joined = rows.join(models, by)
    fit = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
    errors = joined.withColumn("e", F.col("y") - fit)
    parts = errors.select(*by, "y", "e", F.posexplode("x").alias("place", "v"), "weights")
    sums = parts.groupBy(*by, "place").agg(
        F.count("*").alias("n"), F.avg("e").alias("residual"), F.stddev_pop("y").alias("sy"), F.stddev_pop("v").alias("sx"),
        F.covar_pop("v", "e").alias("c"), F.first(F.get("weights", F.col("place"))).alias("w"),
    )
    pull = F.when(F.col("w") != 0, F.col("c") / (F.col("sx") * F.col("sy")) - penalty * F.col("w") * F.col("sx") / F.col("sy"))
    return sums.groupBy(*by).agg(
        F.max("n").alias("rows"), F.max(F.abs(F.col("residual") / F.col("sy"))).alias("residual"), F.max(F.abs(pull)).alias("gradient")
    )


# --- models that travel ---------------------------------------------------------------

@dataclass(frozen=True)
class LogLinear:
    """A linear model on logarithms."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def value(self, x: np.ndarray) -> float:
        """The prediction for the features of one day, unknown ones being NaN."""
        known = np.log1p(np.maximum(np.nan_to_num(x, nan=0.0), 0.0))
        return max(float(np.expm1(min(self.intercept + float(known @ np.array(self.weights)), 50.0))), 0.0)


@dataclass(frozen=True)
class FlatTrees:
    """A sum of trees on the log of the target: one row per tree, children by their place in it."""

    columns: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # of a node: left, right; a leaf has itself
    leaf: np.ndarray
    weight: np.ndarray
    depth: int

    def value(self, x: np.ndarray) -> float:
        """The prediction for the features of one day, unknown ones being NaN."""
        x = np.nan_to_num(x, nan=MISSING)
        trees, at = np.arange(len(self.weight)), np.zeros(len(self.weight), dtype=np.int64)
        for _ in range(self.depth):
            right = x[self.feature[trees, at]] > self.threshold[trees, at]
            at = self.child[trees, at, right.astype(np.int64)]
        return max(float(np.expm1(min(float(self.weight @ self.leaf[trees, at]), 50.0))), 0.0)


def flat_trees(model: PipelineModel, columns: Sequence[str]) -> FlatTrees:
    """The trees of a fitted pipeline as arrays, read from the model's own description."""
    trees: list[list[list[float]]] = []  # nodes: feature, threshold, left, right, value
    weights: list[float] = []
    path: list[int] = []  # nodes on the way whose next branch comes
    deepest = 0
    for line in model.stages[-1].toDebugString.splitlines():
        text = line.strip()
        if m := re.match(r"Tree \d+ \(weight ([-\w.+]+)\)", text):
            trees.append([])
            weights.append(float(m[1]))
            path = []
            continue
        if not trees or not text:
            continue
        nodes = trees[-1]
        if text.startswith("Else"):
            continue  # the right child follows
        at = len(nodes)
        if path:
            parent = nodes[path[-1]]
            side = 2 if parent[2] < 0 else 3
            parent[side] = at
            if side == 3:
                path.pop()
        if m := re.match(r"If \(feature (\d+) <= ([-\w.+]+)\)", text):
            nodes.append([int(m[1]), float(m[2]), -1, -1, 0.0])
            path.append(at)
        elif m := re.match(r"Predict: ([-\w.+]+)", text):
            nodes.append([0, 0.0, at, at, float(m[1])])
        else:
            raise ValueError(f"cannot read the tree line {text!r}")
    width = max(map(len, trees))
    packed = np.zeros((len(trees), width, 5))
    for k, nodes in enumerate(trees):
        packed[k, : len(nodes)] = nodes
        level = {0}
        for depth in range(width):
            step = {int(nodes[i][c]) for i in level for c in (2, 3)}
            if step == level:
                deepest = max(deepest, depth)
                break
            level = step
    whole = packed[:, :, 2:4].astype(np.int64)
    return FlatTrees(
        tuple(columns), packed[:, :, 0].astype(np.int64), packed[:, :, 1], whole, packed[:, :, 4], np.array(weights), deepest
    )


def fit_trees(features: DataFrame, lists: Mapping[str, Sequence[str]] = FEATURES, **params: object) -> dict[str, FlatTrees]:
    """Boosted trees of every target, fitted by Spark side by side and flattened."""
    spark = features.sparkSession

    def fit(name: str) -> FlatTrees:
        columns = lists[name]
        rows = features.withColumn("target", F.col(name)).select("target", *columns)
        return flat_trees(fit_gbt(rows, columns, **params), columns)

    with ThreadPoolExecutor(len(lists)) as pool:  # each fit is a chain of small jobs
        started = {name: pool.submit(inheritable_thread_target(spark)(fit), name) for name in lists}
        return {name: job.result() for name, job in started.items()}


def linear_models(models: DataFrame, keys: Sequence[str] = (), lists: Mapping[str, Sequence[str]] = FEATURES) -> dict[str, dict[str, LogLinear]]:
    """Fitted models by series label and name: a few numbers for each."""
    label = F.concat_ws("|", *keys) if keys else F.lit("all")
    out: dict[str, dict[str, LogLinear]] = {}
    for row in models.select(label.alias("label"), "model", "weights", "intercept").collect():
        columns = tuple(lists[row.model])
        out.setdefault(row.label, {})[row.model] = LogLinear(columns, tuple(row.weights), row.intercept)
    return out


# --- forecasts ----------------------------------------------------------------------------

def known_features(history: DataFrame, keys: Sequence[str] = (), since: int = 2013) -> tuple[DataFrame, DataFrame]:
    """The features of every known day per ``keys``, and the growth they rest on."""
    growth = annual_growth(history, since=since, keys=keys)
    past = history_features(history, series=keys)
    first = history.groupBy(*keys).agg(F.min("date").alias("first"))
    marked = with_row(past, first, "_f", keys)
    marked = calendar_features(marked, F.col("_f.first")).drop("_f")
    base = seasonal_baseline(history, history.select(*keys, "date"), growth, keys=keys)
    return marked.join(base, [*keys, "date"]), growth


def coming_days(history: DataFrame, dates: DataFrame, growth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast dates with their seasonal bases and calendar features."""
    ahead = seasonal_baseline(history, dates.select(*keys, "date"), growth, keys=keys)
    first = history.groupBy(*keys).agg(F.min("date").alias("first"))
    return calendar_features(with_row(ahead, first, "_f", keys), F.col("_f.first")).drop("_f")


def _recipe(name: str) -> tuple[str, str, int]:
    """What a feature is made of: kind, column, days."""
    if m := re.match(r"(\w+)_lag_(\d+)$", name):
        return "lag", m[1], int(m[2])
    if m := re.match(r"(\w+)_roll_(mean|std)_(\d+)$", name):
        return m[2], m[1], int(m[3])
    if m := re.match(r"(\w+)_yoy_lag_mean$", name):
        return "year", m[1], 0
    return "given", name, 0


def day_features(names: Sequence[str], state: Mapping[str, np.ndarray], size: int, given: Mapping[str, float]) -> np.ndarray:
    """The features of the day after the first ``size`` values of ``state``, as ``history_features`` has them; NaN is unknown."""
    out = np.full(len(names), np.nan)
    for i, name in enumerate(names):
        kind, column, days = _recipe(name)
        if kind == "given":
            out[i] = given[column]
        elif kind == "lag":
            if days <= size:
                out[i] = state[column][size - days]
        elif kind == "year":
            values = np.array([state[column][size - k] for k in (364, 365, 366) if k <= size])
            values = values[~np.isnan(values)]
            if len(values):
                out[i] = values.mean()
        else:
            values = state[column][max(0, size - days) : size]
            values = values[~np.isnan(values)]
            if len(values) >= least_values(days):
                out[i] = values.mean() if kind == "mean" else values.std(ddof=1)
    return out


def recursive_forecast(
    history: DataFrame,
    bases: DataFrame,
    models: Mapping[str, Mapping[str, LogLinear | FlatTrees]],
    weights: Mapping[str, tuple[float, float]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Day-by-day forecasts that feed their own values back into the lags: series, variant, date and the five columns.

    ``bases`` has the days of :func:`coming_days`. ``models`` maps a series (its keys joined by ``|``, or ``all``) to its
    models. ``weights`` names variants by the shares of the direct revenue and cost models against orders times order
    value and revenue times cost ratio. One task per series and variant: it gets the last ``REACH`` days only.
    """
    wanted = sorted({c for own in models.values() for m in own.values() for c in m.columns})
    given = [c for c in wanted if _recipe(c)[0] == "given"]
    label = F.concat_ws("|", *keys) if keys else F.lit("all")
    known = history.select(label.alias("series"), "date", *[F.col(c).cast("double").alias(c) for c in SERIES])
    last = known.groupBy("series").agg(F.max("date").alias("_last"))
    known = known.join(last, "series").where(F.datediff("_last", "date") < REACH).drop("_last")
    ahead = bases.select(label.alias("series"), "date", *[F.col(c).cast("double").alias(c) for c in given])
    both = known.withColumn("_ahead", F.lit(False)).unionByName(ahead.withColumn("_ahead", F.lit(True)), allowMissingColumns=True)
    shares = {name: (float(r), float(c)) for name, (r, c) in weights.items()}
    copies = with_grid(both, [{"variant": v} for v in shares])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        series, variant = key
        of_revenue, of_cogs = shares[variant]
        own = models[series]
        rows = rows.sort_values("date")
        past, days = rows[~rows["_ahead"]], rows[rows["_ahead"]]
        size = len(past)
        state = {c: np.concatenate([past[c].to_numpy(float), np.full(len(days), np.nan)]) for c in SERIES}
        places = {c: i for i, c in enumerate(wanted)}
        picks = {name: np.array([places[c] for c in m.columns]) for name, m in own.items()}
        table = days[given].to_dict("records")
        for row in table:
            x = day_features(wanted, state, size, row)
            p = {name: m.value(x[picks[name]]) for name, m in own.items()}
            revenue = of_revenue * p["revenue"] + (1 - of_revenue) * p["orders"] * p["aov"]
            cogs = of_cogs * p["cogs"] + (1 - of_cogs) * revenue * p["cogs_ratio"]
            aov = revenue / p["orders"] if p["orders"] > 1e-9 else p["aov"]
            share = cogs / revenue if revenue > 1e-9 else p["cogs_ratio"]
            for name, value in zip(SERIES, (revenue, cogs, p["orders"], aov, share), strict=True):
                state[name][size] = value
            size += 1
        done = {c: state[c][len(past) :] for c in SERIES}
        return pd.DataFrame({"series": series, "variant": variant, "date": days["date"], **done})

    listed = ", ".join(f"{c} double" for c in SERIES)
    return copies.groupBy("series", "variant").applyInPandas(run, f"series string, variant string, date date, {listed}")
