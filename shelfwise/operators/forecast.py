"""History, seasonal profiles, features, single models and baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import calendar_parts, change, clip, cyclic_parts, ratio, season_flags
from shelfwise.operators.derive import aov_and_cost_ratio
from shelfwise.operators.timeseries import by_date, densify, mean_of, rolled

# Lags, windows, boosts, limits and feature lists of the forecast.
LAGS = [1, 7, 14, 30, 90, 364, 365, 366, 730]
WINDOWS = [7, 30, 90, 365]
SERIES = ["revenue", "cogs", "orders", "aov", "cogs_ratio"]
BOOSTED = ["revenue", "cogs", "orders", "aov"]
GROWTH_LOW, GROWTH_HIGH = 0.95, 1.25
CARRY = 1.0
BOOST = {"revenue": 1.0, "cogs": 1.0, "orders": 1.25, "aov": 1.35}
FEATURES = {
    "revenue": [
        "revenue_seasonal_base", "aov_lag_1", "revenue_lag_1", "revenue_lag_7", "orders_lag_90",
        "orders_lag_7", "orders_roll_std_7", "aov_lag_364", "revenue_lag_365",
        "orders_seasonal_base", "aov_lag_730", "revenue_lag_364",
    ],
    "cogs": [
        "cogs_seasonal_base", "cogs_lag_1", "cogs_lag_364", "cogs_lag_7", "cogs_lag_365",
        "cogs_lag_90", "cogs_lag_730", "cogs_lag_14", "cogs_roll_std_7", "cogs_lag_30",
        "cogs_lag_366", "time_index",
    ],
    "orders": [
        "orders_seasonal_base", "orders_lag_1", "orders_lag_7", "orders_lag_365", "orders_lag_364",
        "orders_lag_730", "orders_lag_366", "orders_lag_90", "orders_lag_14", "year_3_cos",
        "orders_lag_30", "orders_roll_std_7",
    ],
    "aov": [
        "aov_seasonal_base", "aov_lag_1", "aov_lag_30", "aov_lag_730", "aov_lag_90", "aov_lag_366",
        "aov_roll_std_7", "aov_lag_365", "aov_lag_364", "aov_lag_14", "aov_lag_7",
        "aov_roll_mean_7",
    ],
    "cogs_ratio": [
        "cogs_ratio_seasonal_base", "cogs_ratio_lag_1", "cogs_ratio_lag_730",
        "cogs_ratio_roll_std_7", "cogs_ratio_lag_364", "cogs_ratio_lag_30", "cogs_ratio_lag_90",
        "cogs_ratio_lag_365", "cogs_ratio_roll_mean_7", "cogs_ratio_yoy_lag_mean",
        "cogs_ratio_lag_366", "time_index",
    ],
}
MISSING = -1.0  # stands for an unknown lag; every feature is non-negative


def load_history(sales: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Gap-free daily revenue, cost, orders, order value and cost ratio."""
    zero = {"revenue": 0.0, "cogs": 0.0, "orders": 0}
    dense = densify(sales.select(*series, "date", "revenue", "cogs", "orders"), zero, series)
    return aov_and_cost_ratio(dense, series)


def until(history: DataFrame, day: str) -> DataFrame:
    """History up to and including a day."""
    return history.where(F.col("date") <= F.lit(day).cast("date"))


def annual_growth(
    history: DataFrame,
    columns: Sequence[str] = SERIES,
    since: int = 2013,
    carry: float = CARRY,
    boost: Mapping[str, float] = BOOST,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row of yearly growth factors of every column (per ``keys``, if given).

    A positive last change is carried forward, times the boost of its column; with
    ``carry=0``, after a fall and for ratios the geometric mean of the changes since a
    year is used. Both are limited.
    """
    years = history.groupBy(*keys, F.year("date").alias("year")).agg(
        *[F.nullif(F.avg(c), F.lit(0.0)).alias(c) for c in columns]
    )
    order = Window.partitionBy(*keys).orderBy("year")
    moved = years.select(
        *keys, "year", *[change(F.col(c), F.lag(c).over(order)).alias(c) for c in columns]
    )
    out = []
    for c in columns:
        last = F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year")))
        steady = F.exp(F.avg(F.when(F.col("year") >= since, F.ln(1 + F.col(c)))))
        carried = 1 + last * carry * boost.get(c, 1.0)
        use = (last > 0) & F.lit(carry > 0 and c in BOOSTED)
        growth = F.when(F.coalesce(use, F.lit(False)), carried).otherwise(F.coalesce(steady, F.lit(1.0)))
        out.append(clip(growth, GROWTH_LOW, GROWTH_HIGH).alias(c))
    return moved.groupBy(*keys).agg(*out)


def seasonal_profile(history: DataFrame, columns: Sequence[str] = SERIES, keys: Sequence[str] = ()) -> DataFrame:
    """Value over its year's mean, averaged per month and day."""
    year = Window.partitionBy(*keys, F.year("date"))
    normed = history.select(
        *keys,
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        *[ratio(F.col(c), F.avg(c).over(year)).alias(c) for c in columns],
    )
    return normed.groupBy(*keys, "month", "day").agg(*[F.avg(c).alias(f"{c}_profile") for c in columns])


def latest_level(history: DataFrame, columns: Sequence[str] = SERIES, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the last year on record, in one row (per ``keys``)."""
    years = history.groupBy(*keys, F.year("date").alias("year")).agg(*[F.avg(c).alias(c) for c in columns])
    return years.groupBy(*keys).agg(
        F.max("year").alias("year"), *[F.max_by(c, "year").alias(c) for c in columns]
    )


def with_row(df: DataFrame, row: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the one row of ``row`` (the one of equal ``keys``) as a struct column."""
    if not keys:
        return df.withColumn(name, row.select(F.struct("*")).scalar())
    return df.join(row.select(*keys, F.struct(*[c for c in row.columns if c not in keys]).alias(name)), list(keys), "left")


def seasonal_baseline(
    history: DataFrame, dates: DataFrame, growth: DataFrame, columns: Sequence[str] = SERIES, keys: Sequence[str] = ()
) -> DataFrame:
    """Level times growth to the power of years ahead times profile (1 where unknown)."""
    keyed = dates.withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})
    joined = keyed.join(seasonal_profile(history, columns, keys), [*keys, "month", "day"], "left")
    joined = with_row(joined, latest_level(history, columns, keys), "_l", keys)
    joined = with_row(joined, growth.select(*keys, *columns), "_g", keys)
    ahead = F.year("date") - F.col("_l.year")
    return joined.select(
        *dates.columns,
        *[
            (
                F.col(f"_l.{c}")
                * F.pow(F.col(f"_g.{c}"), ahead)
                * F.coalesce(f"{c}_profile", F.lit(1.0))
            ).alias(f"{c}_seasonal_base")
            for c in columns
        ],
    )


def reference_features(history: DataFrame, dates: DataFrame, growth: DataFrame, columns: Sequence[str] = SERIES) -> DataFrame:
    """Seasonal base and its log, and month, quarter and weekday averages per date."""
    out = seasonal_baseline(history, dates, growth, columns)
    out = out.withColumns(
        {
            f"{c}_seasonal_base_log": F.log1p(F.greatest(f"{c}_seasonal_base", F.lit(0.0)))
            for c in columns
        }
    )
    parts = {"month": F.month, "quarter": F.quarter, "weekday": F.weekday}
    for name, part in parts.items():
        means = history.groupBy(part("date").alias(f"_{name}")).agg(
            *[F.avg(c).alias(f"{c}_{name}_avg") for c in columns]
        )
        out = out.withColumn(f"_{name}", part("date")).join(means, f"_{name}", "left").drop(f"_{name}")
    return out


def least_values(window: int) -> int:
    """Known values that a rolling feature of ``window`` days needs."""
    return max(2, min(window // 3, 30))


def history_features(history: DataFrame, columns: Sequence[str] = SERIES, series: Sequence[str] = ()) -> DataFrame:
    """Lags, year-ago mean and leak-safe rolling statistics of every series."""
    order = by_date(series)
    out: dict[str, Column] = {}
    for c in columns:
        out |= {f"{c}_lag_{k}": F.lag(c, k).over(order) for k in LAGS}
        out[f"{c}_yoy_lag_mean"] = mean_of(*[F.lag(c, k).over(order) for k in (364, 365, 366)])
        for w in WINDOWS:
            out[f"{c}_roll_mean_{w}"] = rolled(c, w, "mean", least_values(w), 1, series)
            out[f"{c}_roll_std_{w}"] = rolled(c, w, "std", least_values(w), 1, series)
    return history.withColumns(out)


def calendar_features(dates: DataFrame, first_day: Column) -> DataFrame:
    """Calendar parts, season flags and cyclical encodings of each date."""
    day = F.col("date")
    parts = {**calendar_parts(day), **season_flags(day)}
    plain = {n: e.cast("int") for n, e in parts.items()}
    index = F.datediff("date", first_day)
    return dates.withColumns({"time_index": index.cast("double"), **plain, **cyclic_parts(day)})


def feature_matrix(history: DataFrame, growth: DataFrame, target: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Calendar, reference and history features of every history date.

    With ``target`` only the columns on its allow-list are kept. References come from the rows of ``known`` (the whole
    history without it), so that later dates can be scored without having been seen.
    """
    first = history.agg(F.min("date")).scalar()
    past = history_features(history)
    base = reference_features(history if known is None else known, history.select("date"), growth)
    marked = calendar_features(past.withColumn("_first", first), F.col("_first")).drop("_first")
    joined = marked.join(base, "date")
    if target is None:
        return joined
    return joined.select("date", F.col(target).alias("target"), *FEATURES[target])


# --- models ---------------------------------------------------------------------

def fit_gbt(features: DataFrame, columns: Sequence[str], **params: object) -> PipelineModel:
    """Gradient-boosted trees on the log of the target; unknown lags get a sentinel."""
    filled = features.where("target IS NOT NULL").fillna(MISSING, list(columns))
    ready = filled.withColumn("label", F.log1p(F.greatest("target", F.lit(0.0))))
    settings = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.9, "seed": 42}
    trees = GBTRegressor(featuresCol="features", labelCol="label", **{**settings, **params})
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return Pipeline(stages=[assembler, trees]).fit(ready)


def predict(model: PipelineModel, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predictions on the original scale, never negative."""
    scored = model.transform(features.fillna(MISSING, list(columns)))
    value = F.greatest(F.expm1("prediction"), F.lit(0.0))
    return scored.withColumn("predicted", value).drop("features", "prediction")


def feature_importance(model: PipelineModel, columns: Sequence[str], spark, n: int = 12) -> DataFrame:
    """The ``n`` most important features of a tree model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(columns, weights, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


# --- baselines ------------------------------------------------------------------

def seasonal_naive(history: DataFrame, dates: DataFrame, value: str = "revenue", horizon: int = 364, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the values 364-366 days earlier, else the month's mean, else the last month.

    A block of 364 days never needs its own values, so a horizon of ``horizon`` days
    takes ``ceil(horizon / 364)`` passes of equi joins.
    """
    known = history.select(*keys, "date", F.col(value).alias("v"))
    last = known.groupBy(*keys).agg(F.max("date").alias("_last"))
    months = known.groupBy(*keys, F.month("date").alias("_m")).agg(F.avg("v").alias("_month"))

    def attach(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
        if on:
            return df.join(other, list(on), "left")
        return df.withColumn("_x", other.select(F.struct("*")).scalar()).select("*", "_x.*").drop("_x")

    recent = attach(known, last, keys).where(F.datediff("_last", "date") < 30)
    tail = recent.groupBy(*keys).agg(F.avg("v").alias("_tail"))
    todo = attach(attach(dates.select(*keys, "date"), last, keys), tail, keys)
    todo = todo.withColumn("_step", F.datediff("date", "_last"))
    state, done = known, None
    for block in range(-(-horizon // 364)):
        part = todo.where(F.ceil(F.col("_step") / 364.0) == block + 1)
        reach = F.explode(F.array(*[F.date_add("date", k) for k in (364, 365, 366)]))
        year_ago = (
            state.select(*keys, reach.alias("date"), "v")
            .groupBy(*keys, "date")
            .agg(F.avg("v").alias("_year"))
        )
        part = part.join(year_ago, [*keys, "date"], "left")
        part = part.withColumn("_m", F.month("date")).join(months, [*keys, "_m"], "left")
        naive = F.coalesce("_year", "_month", "_tail")
        found = part.select(*keys, "date", F.greatest(naive, F.lit(0.0)).alias("v"))
        state = state.unionByName(found)
        done = found if done is None else done.unionByName(found)
    return done.withColumnRenamed("v", f"{value}_naive")


def horizon_awareness(dates: DataFrame, steps: Sequence[int] = (1, 7, 14, 30, 60, 90, 180, 365)) -> DataFrame:
    """Per lag: forecast days with a known value and days that need own predictions."""
    start = dates.agg(F.min("date").alias("s")).scalar()
    copies = dates.withColumns({"_s": start, "lag": F.explode(F.array(*[F.lit(k) for k in steps]))})
    known = F.date_sub("date", F.col("lag")) < F.col("_s")
    return copies.groupBy("lag").agg(
        F.count_if(known).alias("known_days"),
        F.count_if(~known).alias("recursive_days"),
        F.min(F.when(~known, F.col("date"))).alias("first_recursive"),
        ratio(F.count_if(~known), F.count("*")).alias("recursive_share"),
    )


def window_awareness(dates: DataFrame, windows: Sequence[int] = (7, 14, 30, 90, 180, 365)) -> DataFrame:
    """Per rolling window: days fully known, partly and mostly built on predictions."""
    start = dates.agg(F.min("date").alias("s")).scalar()
    copies = dates.withColumns({"_s": start, "window": F.explode(F.array(*[F.lit(w) for w in windows]))})
    need = F.least(F.datediff("date", "_s"), F.col("window"))
    return copies.groupBy("window").agg(
        F.count_if(need == 0).alias("known_days"),
        F.count_if((need > 0) & (need < F.col("window") / 2)).alias("partly_recursive"),
        F.count_if((need > 0) & (need >= F.col("window") / 2)).alias("mostly_recursive"),
        F.min(F.when(need > 0, F.col("date"))).alias("first_recursive"),
        F.max(need).alias("deepest"),
    )


def boundary_check(history: DataFrame, start: str) -> DataFrame:
    """Days missing between the history and the forecast and in its last 30 days."""
    day = F.lit(start).cast("date")
    last = history.agg(F.max("date").alias("last")).scalar()
    tail = history.select("date").distinct().withColumn("_last", last)
    return tail.agg(
        F.max("_last").alias("last_known"),
        (F.datediff(day, F.max("_last")) - 1).alias("gap_days"),
        (30 - F.count_if(F.datediff("_last", "date") < 30)).alias("trailing_missing"),
    ).withColumn("continuous", (F.col("gap_days") == 0) & (F.col("trailing_missing") == 0))


def template_check(template: DataFrame, start: str, end: str) -> DataFrame:
    """Whether a forecast template has every day of a range exactly once."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = F.datediff(b, a) + 1
    row = template.agg(
        F.count("*").alias("rows"),
        F.count_distinct("date").alias("days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("date").between(a, b)).alias("inside"),
    )
    ok = (F.col("rows") == days) & (F.col("days") == days) & (F.col("inside") == days)
    return row.withColumns({"expected_days": days, "valid": ok}).drop("inside")
