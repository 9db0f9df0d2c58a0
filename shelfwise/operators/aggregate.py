"""Grouped statistics, correlations, fits and pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.ordered import average_rank_over, null_safe_join, quantiles
from shelfwise.functions.scalars import log1p_safe, ratio, skew_adjusted, weighted_mean


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum, mean, exact median, deviation, extremes and size per group."""
    stats = df.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count("*").alias("rows"),
    )
    return null_safe_join(stats, quantiles(df, value, {"median": 0.5}, keys), list(keys), "left")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Several exact percentiles per group."""
    return quantiles(df, value, probs, keys)


def by_each(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """``df`` once per dimension, with ``dim`` (its name) and ``grp`` (its value as text): one aggregate over both answers
    for all dimensions from one scan."""
    entries = [F.struct(F.lit(n).alias("dim"), c.cast("string").alias("grp")) for n, c in dimensions.items()]
    return df.withColumn("_d", F.explode(F.array(*entries))).withColumns({"dim": F.col("_d.dim"), "grp": F.col("_d.grp")}).drop("_d")


def share_by(df: DataFrame, keys: Sequence[str], total: Column, within: Sequence[str] = ()) -> DataFrame:
    """Group totals and their share of the whole or of an outer group."""
    sums = df.groupBy(*keys).agg(total.alias("total"))
    whole = F.sum("total").over(Window.partitionBy(*within))
    return sums.withColumn("share", ratio(F.col("total"), whole))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Rows per value with their share."""
    return share_by(df, [value], F.count("*"))


def weighted_means(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Weighted mean of several columns per group."""
    return df.groupBy(*keys).agg(
        *[weighted_mean(F.col(v), F.col(weight)).alias(v) for v in values]
    )


def group_mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(value))).getField(value).alias("mode"),
        F.max("n").alias("occurrences"),
    )


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the row that comes last in ``order`` per group."""
    row = F.max(F.struct(*order, *columns)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row.{c}") for c in [*order, *columns]])


def extreme_rows(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str) -> DataFrame:
    """Row with the lowest and row with the highest value per group."""
    low = F.min(F.struct(value, tiebreak)).alias("low")
    high = F.max(F.struct(F.col(value), (-F.col(tiebreak)).alias("tie"))).alias("high")
    return df.groupBy(*keys).agg(low, high).select(
        *keys,
        F.col(f"low.{value}").alias(f"min_{value}"),
        F.col(f"low.{tiebreak}").alias(f"min_{tiebreak}"),
        F.col(f"high.{value}").alias(f"max_{value}"),
        (-F.col("high.tie")).alias(f"max_{tiebreak}"),
    )


def pivot_fill(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, agg: Column, prefix: str = "") -> DataFrame:
    """Pivot over an explicit value list; absent cells are 0."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(agg)
    return wide.select(
        *keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in values]
    )


def pivot_metrics(df: DataFrame, keys: Sequence[str], column: str, names: Mapping[object, str], aggs: Mapping[str, Column]) -> DataFrame:
    """Two-level pivot: one column per group name and metric."""
    wide = df.groupBy(*keys).pivot(column, list(names)).agg(*[e.alias(n) for n, e in aggs.items()])
    shown = []
    for value, label in names.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        for metric in aggs:
            shown.append(
                F.coalesce(F.col(f"`{text}_{metric}`"), F.lit(0)).alias(f"{label}_{metric}")
            )
    return wide.select(*keys, *shown)


def worst_group(df: DataFrame, period: str, group: str, rate: Column) -> DataFrame:
    """Highest group rate per period and the group that has it."""
    rates = df.groupBy(period, group).agg(rate.alias("rate"))
    top = F.max(F.struct("rate", group)).alias("top")
    return rates.where("rate IS NOT NULL").groupBy(period).agg(
        top, F.min("rate").alias("lowest_rate")
    ).select(
        period,
        F.col("top.rate").alias("worst_rate"),
        F.col(f"top.{group}").alias("worst_group"),
        (F.col("top.rate") - F.col("lowest_rate")).alias("spread"),
    )


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson coefficients of column pairs, one row per pair (and group)."""
    row = df.groupBy(*keys).agg(
        *[safe_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def safe_corr(x: Column, y: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Correlation of complete pairs, null without spread on either side.

    Built from the covariance because the built-in coefficient divides by zero under
    ANSI rules. ``over`` turns the aggregates into window aggregates.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    spread = over(F.stddev_pop(a)) * over(F.stddev_pop(b))
    return over(F.covar_pop(a, b)) / F.nullif(spread, F.lit(0.0))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of ``columns``, the upper triangle with the diagonal."""
    return correlations(df, list(combinations_with_replacement(columns, 2)))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of complete pairs of a calendar-bounded frame."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = both.withColumns(
        {"_rx": average_rank_over(F.col(x), keys), "_ry": average_rank_over(F.col(y), keys)}
    )
    return ranks.groupBy(*keys).agg(
        safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman"), F.count("*").alias("pairs")
    )


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of the least-squares line per group."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("pairs"),
    )


def fit_band(df: DataFrame, x: str, y: str, points: int = 100, width: float = 1.98) -> DataFrame:
    """Fitted line with its confidence band on an even grid of ``points`` values."""
    stats = df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_avgx(y, x).alias("center"),
        F.regr_count(y, x).alias("n"),
        F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("low"),
        F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("high"),
    )
    grid = stats.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / (points - 1)
    error = F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    sigma = F.sqrt(F.greatest(error, F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0)))
    spread = F.sqrt(1 / F.col("n") + ratio(F.pow(at - F.col("center"), 2), F.col("sxx")))
    fitted = F.col("intercept") + F.col("slope") * at
    return grid.select(
        "step",
        at.alias("x"),
        fitted.alias("fitted"),
        (fitted - width * sigma * spread).alias("low_band"),
        (fitted + width * sigma * spread).alias("high_band"),
    )


def skew_raw_and_log(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bias-adjusted skewness of a value and of its log."""
    return df.groupBy(*keys).agg(
        skew_adjusted(F.col(value)).alias("skew"),
        skew_adjusted(log1p_safe(F.col(value))).alias("log_skew"),
        F.count(value).alias("n"),
    )


def variation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Coefficient of variation and min-max spread per group."""
    return df.groupBy(*keys).agg(
        ratio(F.stddev_samp(value), F.avg(value)).alias("cv"),
        (F.max(value) - F.min(value)).alias("spread"),
    )


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin is closed."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    ends = ends.select(F.struct("low", "high")).scalar()
    placed = df.where(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("v"), ends.alias("e")
    )
    width = (F.col("e.high") - F.col("e.low")) / bins
    index = F.least(F.floor(ratio(F.col("v") - F.col("e.low"), width)), F.lit(bins - 1))
    return (
        placed.select(
            F.coalesce(index, F.lit(0)).alias("bin"),
            F.col("e.low").alias("low"),
            width.alias("width"),
        )
        .groupBy("bin")
        .agg(F.count("*").alias("rows"), F.max("low").alias("low"), F.max("width").alias("width"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("left_edge"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("right_edge"),
            "rows",
        )
    )


def side_by_side(df: DataFrame, parts: Mapping[str, Column], value: str) -> DataFrame:
    """Mean and count overall and by each part, from one scan."""
    keyed = df.select(F.col(value).alias("_v"), *[e.cast("string").alias(n) for n, e in parts.items()])
    names = list(parts)
    sets = [[], *[[F.col(n)] for n in names]]
    grouped = keyed.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.avg("_v").alias("mean"), F.count("_v").alias("rows"), F.grouping_id().alias("_g")
    )
    label = F.lit("overall")
    for i, n in enumerate(reversed(names)):
        mask = (1 << len(names)) - 1 - (1 << i)
        label = F.when(F.col("_g") == mask, n).otherwise(label)
    return grouped.select(
        label.alias("part"), F.coalesce(*names).alias("value"), "mean", "rows"
    )


def distinct_list(df: DataFrame, keys: Sequence[str], value: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` distinct values per group as text, with the distinct count.

    Distinct pairs are ranked before they are gathered, so a group's list never
    holds more than ``limit`` entries.
    """
    pairs = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    shown = F.when(F.col("_place") <= limit, F.col(value))
    return pairs.withColumn("_place", place).groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(shown)), ", ").alias("values"),
        F.count("*").alias("distinct_values"),
    )


# --- sums of products --------------------------------------------------------------

def gram(rows: DataFrame, keys: Sequence[str], values: Column) -> DataFrame:
    """Sums of products of any two entries of an array per ``keys``: keys, place, total.

    The pair of entries i and j <= i, both from 0, has the place i * (i + 1) / 2 + j. Every Arrow batch is multiplied at once
    and leaves one row per key, whatever its rows; arrays of one key have one length and no unknown entries.
    """
    picked = rows.select(*keys, values.cast("array<double>").alias("_v"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("_totals", T.ArrayType(T.DoubleType()))])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(keys))
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            if keys:
                codes = batch.select(list(keys)).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
            totals = []
            for where in groups:
                block = flat[starts[where][:, None] + np.arange(sizes[where[0]])]
                totals.append((block.T @ block)[np.tril_indices(block.shape[1])])
            firsts = pa.array([int(where[0]) for where in groups])
            columns = [batch.column(i).take(firsts) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, type=pa.list_(pa.float64()))], names=schema.names)

    parts = picked.mapInArrow(multiply, schema).select(*keys, F.posexplode("_totals").alias("place", "p"))
    return parts.groupBy(*keys, "place").agg(F.sum("p").alias("total"))


def square(places: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The symmetric matrix of the sums of :func:`gram`."""
    size = int((np.sqrt(8 * (places.max() + 1) + 1) - 1) / 2 + 0.5)
    out = np.zeros((size, size))
    i, j = np.tril_indices(size)
    out[i[places], j[places]] = out[j[places], i[places]] = totals
    return out
