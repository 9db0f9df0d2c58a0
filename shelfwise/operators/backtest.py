"""Rolling-origin folds, metrics, calibration grids and strategy choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import horizon_band, ratio
from shelfwise.operators.forecast import seasonal_naive
from shelfwise.operators.joins import with_grid
from shelfwise.operators.recursion import coming_days, fit_linear, known_features, linear_models, recursive_forecast, training_rows
from shelfwise.sources.session import checkpointed

Fold = tuple[str, str, str, str]  # name, last training day, first and last validation day


def rolling_origin(history: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """History rows of every fold, marked train or validate, with the horizon day."""
    grid = [dict(zip(("fold", "train_end", "val_start", "val_end"), f, strict=True)) for f in folds]
    copies = with_grid(history, grid)
    day = F.col("date")
    role = F.when(day <= F.col("train_end").cast("date"), "train").when(
        day.between(F.col("val_start").cast("date"), F.col("val_end").cast("date")), "validate"
    )
    step = F.datediff("date", F.col("val_start").cast("date")) + 1
    return (
        copies.withColumns({"role": role, "horizon_day": F.when(role == "validate", step)})
        .where("role IS NOT NULL")
        .drop("train_end", "val_start", "val_end")
    )


def fold_predictions(history: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Fold by date table of actuals and three baseline predictions.

    Direct is the seasonal naive value; component is the month's mean orders times
    its mean order value; current is their mean. Costs follow the training ratio.
    """
    rows = rolling_origin(history, folds)
    train, ahead = rows.where("role = 'train'"), rows.where("role = 'validate'")
    direct = seasonal_naive(train, ahead, "revenue", 732, ["fold"])
    months = train.groupBy("fold", F.month("date").alias("_m")).agg(
        (F.avg("orders") * F.avg("aov")).alias("pred_component"),
        F.avg("orders").alias("pred_orders"),
        F.avg("aov").alias("pred_aov"),
    )
    costs = train.groupBy("fold").agg(ratio(F.sum("cogs"), F.sum("revenue")).alias("pred_cogs_ratio"))
    joined = (
        ahead.withColumn("_m", F.month("date"))
        .join(direct.withColumnRenamed("revenue_naive", "pred_direct"), ["fold", "date"], "left")
        .join(months, ["fold", "_m"], "left")
        .join(costs, "fold", "left")
    )
    current = (F.col("pred_direct") + F.col("pred_component")) / 2
    return joined.select(
        "fold",
        "date",
        "horizon_day",
        F.col("revenue").alias("actual_revenue"),
        F.col("cogs").alias("actual_cogs"),
        "pred_direct",
        "pred_component",
        current.alias("pred_current"),
        (current * F.col("pred_cogs_ratio")).alias("pred_cogs"),
        "pred_orders",
        "pred_aov",
        "pred_cogs_ratio",
    )


# --- metrics --------------------------------------------------------------------

def metric_columns(actual: Column, pred: Column) -> list[Column]:
    """Error metrics of one aggregate; null-safe where a denominator is zero."""
    error = pred - actual
    size = F.abs(actual) + F.abs(pred)
    n = F.count(error)
    spread = F.var_pop(F.when(pred.isNotNull(), actual)) * n
    return [
        n.alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - ratio(F.sum(error * error), spread)).alias("r2"),
        (F.avg(F.abs(error) / F.nullif(F.abs(actual), F.lit(0.0))) * 100).alias("mape"),
        (F.avg(2 * F.abs(error) / F.nullif(size, F.lit(0.0))) * 100).alias("smape"),
        F.avg(error).alias("bias"),
        ratio(F.avg(pred), F.avg(actual)).alias("mean_ratio"),
    ]


def forecast_metrics(df: DataFrame, actual: str, pred: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, MAPE, sMAPE, bias and mean ratio per group."""
    value = F.col(pred) if isinstance(pred, str) else pred
    return df.groupBy(*keys).agg(*metric_columns(F.col(actual), value))


def bias_table(df: DataFrame, targets: Mapping[str, tuple[str, str]], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Mean, median and deviation of actual and predicted values per group and target."""
    out = None
    for name, (actual, pred) in targets.items():
        rows = df.groupBy(*keys).agg(
            F.avg(actual).alias("actual_mean"),
            F.avg(pred).alias("prediction_mean"),
            F.percentile(actual, F.lit(0.5)).alias("actual_median"),
            F.percentile(pred, F.lit(0.5)).alias("prediction_median"),
            F.avg(F.col(pred) - F.col(actual)).alias("bias"),
            ratio(F.avg(pred), F.avg(actual)).alias("mean_ratio"),
            ratio(F.stddev_samp(pred), F.stddev_samp(actual)).alias("volatility_ratio"),
        ).withColumn("target", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def metrics_by_horizon(preds: DataFrame, actual: str, pred: str) -> DataFrame:
    """Metrics per fold and horizon bucket."""
    return forecast_metrics(
        preds.withColumn("band", horizon_band(F.col("horizon_day"))), actual, pred, ["fold", "band"]
    )


def metrics_by_month(preds: DataFrame, actual: str, pred: str) -> DataFrame:
    """Metrics per fold and month of the year."""
    return forecast_metrics(preds.withColumn("month", F.month("date")), actual, pred, ["fold", "month"])


# --- strategies -----------------------------------------------------------------

def blend() -> Column:
    """Weighted mean of direct and component prediction."""
    w = F.col("w")
    return w * F.col("pred_direct") + (1 - w) * F.col("pred_component")


def strategy_value(kind: Column) -> Column:
    """Prediction of a strategy row joined to the fold predictions."""
    current = F.col("pred_current")
    horizon = F.when(F.col("horizon_day") <= 365, F.col("year1")).otherwise(F.col("year2"))
    growth = F.pow(1 + F.col("growth"), (F.col("horizon_day") - 1) / F.lit(365.0))
    return (
        F.when(kind == "current", current)
        .when(kind == "scale", current * F.col("scale"))
        .when(kind == "horizon", current * horizon)
        .when(kind == "ensemble", blend())
        .when(kind == "ensemble_scale", blend() * F.col("scale"))
        .when(kind == "growth", current * growth)
        .when(kind == "seasonal_blend", F.col("alpha") * current + (1 - F.col("alpha")) * F.col("pred_direct"))
    )


BLANK = {"scale": 1.0, "year1": 1.0, "year2": 1.0, "w": 1.0, "growth": 0.0, "alpha": 1.0}


def strategy_apply(preds: DataFrame, strategies: Sequence[Mapping[str, object]]) -> DataFrame:
    """Predictions under each strategy of a small literal list (``name``, ``kind``, parameters)."""
    grid = [{**BLANK, **s} for s in strategies]
    copies = with_grid(preds, grid)
    return copies.withColumn("predicted", strategy_value(F.col("kind"))).drop(*BLANK)


def grid_eval(preds: DataFrame, grid: Sequence[Mapping[str, object]], value: Column) -> DataFrame:
    """Metrics of every grid point in every fold."""
    copies = with_grid(preds, grid)
    return forecast_metrics(copies, "actual_revenue", value, ["fold", *grid[0]])


def global_scale(preds: DataFrame, scales: Sequence[float]) -> DataFrame:
    """One factor for all days."""
    return grid_eval(preds, [{"scale": s} for s in scales], F.col("pred_current") * F.col("scale"))


def horizon_scale(preds: DataFrame, year1: Sequence[float], year2: Sequence[float]) -> DataFrame:
    """One factor for the first year and one for the rest."""
    grid = [{"year1": a, "year2": b} for a in year1 for b in year2]
    factor = F.when(F.col("horizon_day") <= 365, F.col("year1")).otherwise(F.col("year2"))
    return grid_eval(preds, grid, F.col("pred_current") * factor)


def ensemble(preds: DataFrame, weights: Sequence[float], scales: Sequence[float] = (1.0,)) -> DataFrame:
    """Weight of the direct prediction, and a factor."""
    grid = [{"w": w, "scale": s} for w in weights for s in scales]
    return grid_eval(preds, grid, blend() * F.col("scale"))


def recent_level(preds: DataFrame, history: DataFrame, folds: Sequence[Fold], windows: Sequence[int]) -> DataFrame:
    """Scale each fold so its first month meets the mean of the last training days."""
    train = rolling_origin(history, folds).where("role = 'train'")
    last = train.groupBy("fold").agg(F.max("date").alias("_last"))
    copies = with_grid(train.join(last, "fold"), [{"window": w} for w in windows])
    tail = copies.where(F.datediff("_last", "date") < F.col("window"))
    recent = tail.groupBy("fold", "window").agg(F.avg("revenue").alias("_recent"))
    first = preds.where("horizon_day <= 30").groupBy("fold").agg(F.avg("pred_current").alias("_first"))
    factors = recent.join(first, "fold").withColumn(
        "multiplier", F.when(F.col("_first") > 0, F.col("_recent") / F.col("_first")).otherwise(1.0)
    )
    joined = preds.join(factors.select("fold", "window", "multiplier"), "fold")
    value = F.col("pred_current") * F.col("multiplier")
    return forecast_metrics(joined, "actual_revenue", value, ["fold", "window", "multiplier"])


def growth_multiplier(preds: DataFrame, rates: Sequence[float]) -> DataFrame:
    """Yearly growth spread over the horizon."""
    factor = F.pow(1 + F.col("growth"), (F.col("horizon_day") - 1) / F.lit(365.0))
    return grid_eval(preds, [{"growth": g} for g in rates], F.col("pred_current") * factor)


def seasonal_blend(preds: DataFrame, naive: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Model prediction mixed with the seasonal naive one."""
    joined = preds.join(naive.withColumnRenamed("revenue_naive", "naive"), ["fold", "date"])
    value = F.col("alpha") * F.col("pred_current") + (1 - F.col("alpha")) * F.col("naive")
    return grid_eval(joined, [{"alpha": a} for a in alphas], value)


def cogs_scale_cap(preds: DataFrame, scales: Sequence[float], caps: Sequence[float | None]) -> DataFrame:
    """Cost factor and cap as a share of revenue: metrics and days above revenue."""
    grid = [
        {"scale": s, "cap": float("inf") if c is None else c, "cap_name": "no_cap" if c is None else f"cap_{c:.2f}"}
        for s in scales
        for c in caps
    ]
    scaled = F.col("pred_cogs") * F.col("scale")
    capped = F.when(F.col("cap_name") == "no_cap", scaled).otherwise(
        F.least(scaled, F.col("pred_current") * F.col("cap"))
    )
    copies = with_grid(preds, grid).withColumn("_c", capped)
    share = F.when(F.col("pred_current") > 0, F.col("_c") / F.col("pred_current"))
    return copies.groupBy("fold", "scale", "cap_name").agg(
        *metric_columns(F.col("actual_cogs"), F.col("_c")),
        F.count_if(F.col("_c") > F.col("pred_current")).alias("days_above_revenue"),
        F.max(share).alias("max_share"),
        F.avg(share).alias("mean_share"),
    )


def summarize_grid(details: DataFrame, keys: Sequence[str], recent: Sequence[str] = ("C", "D")) -> DataFrame:
    """Fold means and deviation of each grid point, over all and over recent folds."""
    late = F.col("fold").isin(*recent)
    cells = []
    for name, test in (("all", F.lit(True)), ("recent", late)):
        pick = lambda c, t=test: F.when(t, F.col(c))
        cells += [F.avg(pick(m)).alias(f"{name}_{m}") for m in ("mae", "rmse", "r2", "bias", "mean_ratio")]
        cells.append(F.stddev_samp(pick("mae")).alias(f"{name}_std_mae"))
    return details.groupBy(*keys).agg(*cells)


def select_best(summary: DataFrame, metric: str = "all_mae", stability: str = "all_std_mae", near: float = 1.01) -> DataFrame:
    """Most stable row among those within one percent of the best."""
    best = F.min(metric).over(Window.partitionBy())
    keys = [c for c in summary.columns if c not in (metric, stability)]
    close = summary.withColumn("_best", best).where(F.col(metric) <= F.col("_best") * near)
    return close.orderBy(F.asc_nulls_last(stability), metric, *keys).limit(1).drop("_best")


def refined_scales(preds: DataFrame, coarse: Sequence[float], reach: int = 5) -> DataFrame:
    """Second pass around the best coarse factor in steps of 0.01."""
    summary = summarize_grid(global_scale(preds, coarse), ["scale"])
    best = summary.orderBy("all_mae", F.asc_nulls_last("all_std_mae"), "scale").limit(1)
    around = F.transform(
        F.sequence(F.lit(-reach), F.lit(reach)), lambda i: F.round(F.col("_best") + i / 100.0, 2)
    )
    copies = preds.withColumn("_best", best.select("scale").scalar()).withColumn(
        "scale", F.explode(F.filter(around, lambda s: s > 0))
    )
    value = F.col("pred_current") * F.col("scale")
    return summarize_grid(forecast_metrics(copies, "actual_revenue", value, ["fold", "scale"]), ["scale"])


def blend_weights(preds: DataFrame, steps: int = 10) -> DataFrame:
    """Weight of the direct revenue prediction with the lowest RMSE, smallest on ties."""
    return blend_weights_of(preds, "actual_revenue", "pred_direct", "pred_component", steps)


def candidate_comparison(preds: DataFrame, revenue: Sequence[Mapping[str, object]], cogs: Sequence[Mapping[str, object]], recent: Sequence[str] = ("C", "D")) -> DataFrame:
    """Fold means of every revenue strategy with every cost strategy."""
    grid = [
        {"cogs_strategy": c["name"], "c_scale": c.get("scale", 1.0), "c_cap": c.get("cap") or 1e12} for c in cogs
    ]
    both = with_grid(strategy_apply(preds, revenue).withColumnRenamed("name", "revenue_strategy"), grid)
    costs = F.least(F.col("pred_cogs") * F.col("c_scale"), F.col("predicted") * F.col("c_cap"))
    keys = ["revenue_strategy", "cogs_strategy", "fold"]
    r = forecast_metrics(both, "actual_revenue", "predicted", keys)
    c = forecast_metrics(both, "actual_cogs", costs, keys)
    late = F.col("fold").isin(*recent)
    mean = lambda m, t=None: F.avg(F.when(t, F.col(m)) if t is not None else F.col(m))
    names = ("mae", "rmse", "r2")
    a = r.groupBy(*keys[:2]).agg(
        *[mean(m).alias(f"revenue_{m}_all") for m in names],
        *[mean(m, late).alias(f"revenue_{m}_recent") for m in names],
    )
    b = c.groupBy(*keys[:2]).agg(
        *[mean(m).alias(f"cogs_{m}_all") for m in names],
        *[mean(m, late).alias(f"cogs_{m}_recent") for m in names],
    )
    return a.join(b, keys[:2])


# --- predictions of fitted models ---------------------------------------------------

def model_predictions(history: DataFrame, folds: Sequence[Fold], weights: tuple[float, float] = (0.5, 0.5), since: int = 2013) -> DataFrame:
    """Fold by date table of actuals and recursive predictions of models fitted on each fold's training days.

    All folds and targets are fitted from one aggregate. Three recursions run per fold: from the direct models, from the
    component models, and from both with ``weights``; each feeds on its own values, so the third is no mean of the others.
    """
    rows = rolling_origin(history, folds)
    train, ahead = checkpointed(rows.where("role = 'train'").drop("role", "horizon_day")), rows.where("role = 'validate'")
    features, growth = known_features(train, ["fold"], since)
    models = linear_models(fit_linear(training_rows(features, ["fold"]), ["fold"]), ["fold"])
    variants = {"direct": (1.0, 1.0), "component": (0.0, 0.0), "current": weights}
    found = recursive_forecast(train, coming_days(train, ahead, growth, ["fold"]), models, variants, ["fold"])
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    wide = found.groupBy(F.col("series").alias("fold"), "date").agg(
        *[of(v, "revenue").alias(f"pred_{v}") for v in variants],
        of("current", "cogs").alias("pred_cogs"),
        of("direct", "cogs").alias("pred_cogs_direct"),
        of("component", "cogs").alias("pred_cogs_component"),
        *[of("current", c).alias(f"pred_{c}") for c in ("orders", "aov", "cogs_ratio")],
    )
    actual = ahead.select("fold", "date", "horizon_day", F.col("revenue").alias("actual_revenue"), F.col("cogs").alias("actual_cogs"))
    return actual.join(wide, ["fold", "date"])


def blend_weights_of(preds: DataFrame, actual: str, direct: str, component: str, steps: int = 10) -> DataFrame:
    """Weight of one prediction against another with the lowest RMSE, smallest on ties."""
    grid = [{"w": i / steps} for i in range(steps + 1)]
    value = F.col("w") * F.col(direct) + (1 - F.col("w")) * F.col(component)
    scored = forecast_metrics(with_grid(preds, grid), actual, value, ["w"])
    return scored.select("w", "rmse").withColumn("is_best", F.row_number().over(Window.orderBy(F.round("rmse", 6), "w")) == 1)


def best_weight(table: DataFrame) -> float:
    """The chosen weight of a weight table."""
    return float(table.where("is_best").first()["w"])
