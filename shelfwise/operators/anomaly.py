"""Outliers, spikes, breakouts and level shifts of daily series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import percent_rank_over
from shelfwise.functions.scalars import at_least, at_most, ratio
from shelfwise.operators.derive import zscores
from shelfwise.operators.joins import at_offsets, near_days
from shelfwise.operators.timeseries import by_date, rolled, spaced_top


def yes(flag: Column) -> Column:
    """Flag with missing read as false."""
    return F.coalesce(flag, F.lit(False))


def breakpoints(daily: DataFrame, value: str = "revenue", window: int = 180, gap: int = 90, n: int = 12, series: Sequence[str] = ()) -> DataFrame:
    """Dates where the mean before and the mean from the day after differ most."""
    before = rolled(value, window, "mean", window // 2, 1, series)
    ahead = by_date(series).rowsBetween(1, window)
    after = F.when(F.count(value).over(ahead) >= window // 2, F.avg(value).over(ahead))
    shifts = daily.select(*series, "date", before.alias("before_mean"), after.alias("after_mean"))
    shifts = shifts.withColumn("difference", F.col("after_mean") - F.col("before_mean")).withColumn(
        "pct_difference", ratio(F.col("difference") * 100, F.col("before_mean"))
    )
    scored = shifts.where("pct_difference IS NOT NULL").withColumn(
        "score", F.round(F.abs("pct_difference"), 6)
    )
    picked = spaced_top(scored, "score", gap, n, series)
    reason = F.when(F.col("difference") > 0, "candidate sustained level increase").otherwise(
        "candidate sustained level decrease"
    )
    return scored.join(picked, [*series, "date"]).withColumn("reason", reason)


def within_group_outliers(daily: DataFrame, part: Column, value: str = "revenue") -> DataFrame:
    """Days outside 1.5 interquartile ranges of their own calendar part."""
    keyed = daily.withColumn("part", part)
    fences = keyed.groupBy("part").agg(
        F.percentile(value, F.lit(0.25)).alias("q1"),
        F.percentile(value, F.lit(0.75)).alias("q3"),
        F.count(value).alias("n"),
    ).where("n >= 4 AND q3 > q1")
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return (
        keyed.join(fences, "part")
        .where((F.col(value) < low) | (F.col(value) > high))
        .withColumn("direction", F.when(F.col(value) > high, "high").otherwise("low"))
    )


def global_anomalies(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Every day with z-score, percentile rank and high and low flags of three rules."""
    stats = daily.agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        *[F.percentile(value, F.lit(p)).alias(n) for n, p in {"q1": 0.25, "q3": 0.75, "p01": 0.01, "p99": 0.99}.items()],
    ).select(F.struct("*")).scalar()
    v, s = F.col(value), lambda name: F.col(f"_s.{name}")
    iqr = s("q3") - s("q1")
    scored = daily.withColumn("_s", stats).withColumns(
        {
            "z": ratio(v - s("mean"), s("std")),
            "pct_rank": percent_rank_over(v),
            "iqr_high": yes(v > s("q3") + 1.5 * iqr),
            "iqr_low": yes(v < s("q1") - 1.5 * iqr),
            "pct_high": yes(at_least(v, s("p99"))),
            "pct_low": yes(at_most(v, s("p01"))),
        }
    ).withColumns({"z_high": yes(F.col("z") >= 3), "z_low": yes(F.col("z") <= -3)})
    scored = scored.withColumns(
        {
            "global_high": F.col("z_high") | F.col("iqr_high") | F.col("pct_high"),
            "global_low": F.col("z_low") | F.col("iqr_low") | F.col("pct_low"),
        }
    )
    methods = F.concat_ws(
        ", ",
        F.when(F.col("z_high") | F.col("z_low"), "global_zscore"),
        F.when(F.col("iqr_high") | F.col("iqr_low"), "iqr_rule"),
        F.when(F.col("pct_high") | F.col("pct_low"), "percentile_threshold"),
    )
    direction = (
        F.when(F.col("global_high") & F.col("global_low"), "mixed")
        .when(F.col("global_high"), "high")
        .when(F.col("global_low"), "low")
        .otherwise("none")
    )
    return scored.withColumns(
        {
            "methods": methods,
            "direction": direction,
            "global_anomaly": F.col("global_high") | F.col("global_low"),
        }
    ).drop("_s")


def rolling_anomalies(daily: DataFrame, value: str = "revenue", windows: Sequence[int] = (30, 90), limit: float = 2.5) -> DataFrame:
    """Every day scored against the windows before it."""
    out = daily
    for w in windows:
        least = max(10, int(w * 0.5))
        mean, std = rolled(value, w, "mean", least, 1), rolled(value, w, "std", least, 1)
        out = out.withColumns({"_m": mean, "_d": std}).withColumn(
            f"z_{w}", F.when(F.abs("_d") >= 1e-9, (F.col(value) - F.col("_m")) / F.col("_d"))
        ).drop("_m", "_d")
        out = out.withColumns(
            {f"high_{w}": yes(F.col(f"z_{w}") >= limit), f"low_{w}": yes(F.col(f"z_{w}") <= -limit)}
        )
    any_of = lambda side: F.greatest(*[F.col(f"{side}_{w}") for w in windows])
    return out.withColumns(
        {
            "rolling_high": any_of("high"),
            "rolling_low": any_of("low"),
            "max_abs_z": F.greatest(*[F.abs(f"z_{w}") for w in windows]),
        }
    ).withColumn("rolling_anomaly", F.col("rolling_high") | F.col("rolling_low"))


def all_anomaly_days(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Days flagged by either method, their direction, source and gap to the last one."""
    both = rolling_anomalies(global_anomalies(daily, value).drop("direction"), value)
    flagged = both.where(F.col("global_anomaly") | F.col("rolling_anomaly"))
    high = F.col("global_high") | F.col("rolling_high")
    source = (
        F.when(F.col("global_anomaly") & F.col("rolling_anomaly"), "global_and_rolling")
        .when(F.col("global_anomaly"), "global_only")
        .otherwise("rolling_only")
    )
    return flagged.withColumns(
        {
            "direction": F.when(high, "high").otherwise("low"),
            "source": source,
            "max_abs_score": F.greatest(F.abs("z"), F.abs("z_30"), F.abs("z_90")),
            "gap_days": F.datediff("date", F.lag("date").over(by_date())),
        }
    )


def clustering_share(anomalies: DataFrame, days: int = 3) -> DataFrame:
    """Share of anomalies close after the one before."""
    return anomalies.agg(
        F.count("*").alias("anomalies"), F.count_if(F.col("gap_days") <= days).alias("clustered")
    ).withColumn("cluster_share", F.col("clustered") / F.greatest(F.col("anomalies"), F.lit(1)))


def anomaly_calendar(anomalies: DataFrame) -> DataFrame:
    """High and low anomalies per year and month."""
    return anomalies.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count_if(F.col("direction") == "high").alias("high"),
        F.count_if(F.col("direction") == "low").alias("low"),
    )


def signal_days(daily: DataFrame, value: str, limit: float = 2.0, two_sided: bool = False) -> DataFrame:
    """Days whose value stands out from its own series."""
    scored = zscores(daily.select("date", value), value)
    z = F.abs("z") if two_sided else F.col("z")
    return scored.where(z >= limit).select("date")


def context_overlap(anomalies: DataFrame, signals: Mapping[str, DataFrame], days: int = 7) -> DataFrame:
    """Anomalies with a signal of each context on the day and within ``days`` days."""
    parts = []
    for name, dates in signals.items():
        same = anomalies.join(dates.distinct(), "date", "left_semi").agg(F.count("*").alias("same_day"))
        near = near_days(anomalies, dates, days).agg(
            F.count("*").alias("nearby"),
            F.count_if(F.col("direction") == "high").alias("high_nearby"),
            F.count_if(F.col("direction") == "low").alias("low_nearby"),
        )
        total = dates.agg(F.count_distinct("date").alias("signal_days"))
        stacked = (
            total.unpivot([], ["signal_days"], "metric", "value")
            .unionByName(same.unpivot([], ["same_day"], "metric", "value"))
            .unionByName(near.unpivot([], ["nearby", "high_nearby", "low_nearby"], "metric", "value"))
        )
        parts.append(stacked.withColumn("context", F.lit(name)))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    metrics = ["signal_days", "same_day", "nearby", "high_nearby", "low_nearby"]
    return table.groupBy("context").pivot("metric", metrics).agg(F.max("value"))


def group_spikes(panel: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """Days of each group with z >= 3 or at its own P95."""
    stats = panel.groupBy(group).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.percentile(value, F.lit(0.95)).alias("p95"),
        F.percentile(value, F.lit(0.99)).alias("p99"),
        F.count(value).alias("n"),
    ).where((F.col("n") >= least) & (F.col("std") > 0))
    scored = panel.join(stats, group).withColumns(
        {
            "z": (F.col(value) - F.col("mean")) / F.col("std"),
            "pct_rank": percent_rank_over(F.col(value), [group]),
        }
    )
    return scored.where((F.col("z") >= 3) | (F.col(value) >= F.col("p95")))


def spikes(df: DataFrame, value: str) -> DataFrame:
    """Days with z >= 3, above the upper fence or at P95."""
    stats = df.agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        *[F.percentile(value, F.lit(p)).alias(n) for n, p in {"q1": 0.25, "q3": 0.75, "p95": 0.95}.items()],
    ).select(F.struct("*")).scalar()
    v = F.col(value)
    fence = F.col("_s.q3") + 1.5 * (F.col("_s.q3") - F.col("_s.q1"))
    scored = df.withColumn("_s", stats).withColumn(
        "spike_z", F.coalesce(ratio(v - F.col("_s.mean"), F.col("_s.std")), F.lit(0.0))
    )
    return scored.where(
        (F.col("spike_z") >= 3) | (v >= fence) | (at_least(v, F.col("_s.p95")))
    ).drop("_s")


def high_threshold(df: DataFrame, value: str) -> Column:
    """Larger of P95 and three deviations above the mean, as a scalar."""
    cut = F.greatest(
        F.percentile(value, F.lit(0.95)), F.avg(value) + 3 * F.stddev_pop(value)
    )
    return df.agg(cut.alias("cut")).scalar()


def spike_followup(daily: DataFrame, driver: str, value: str, offsets: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Value on the day of a driver spike and 1, 3 and 7 days later."""
    marked = daily.select("date", driver, value).withColumn("_cut", high_threshold(daily, value))
    later = at_offsets(marked.select("date", value), value, offsets)
    found = spikes(daily.select("date", driver), driver).join(
        later.join(marked.select("date", "_cut"), "date"), "date"
    )
    return found.withColumns(
        {
            "spike_same_day": at_least(F.col(value), F.col("_cut")),
            **{f"spike_plus_{k}": at_least(F.col(f"`{value}_t{k:+d}`"), F.col("_cut")) for k in offsets},
        }
    ).withColumnsRenamed({f"{value}_t{k:+d}": f"{value}_plus_{k}" for k in offsets}).drop("_cut")


def spike_overlap(a: DataFrame, b: DataFrame, days: int = 7) -> DataFrame:
    """Spike dates of two series: same day, b after a, and without a partner."""
    a, b = a.select("date").distinct(), b.select("date").distinct()
    after = F.sequence(F.date_add("date", 1), F.date_add("date", days), F.expr("interval 1 day"))
    follow = a.select(F.explode(after).alias("date")).join(b, "date")
    parts = {
        "same_day": a.join(b, "date"),
        "b_after_a": follow,
        "b_without_a": b.join(a, "date", "left_anti"),
        "a_without_b": a.join(b, "date", "left_anti"),
    }
    table = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("category"), "count")
        table = row if table is None else table.unionByName(row)
    return table


def breakouts(daily: DataFrame, value: str = "revenue", window: int = 30, least: int = 15, pct: float = 10.0) -> DataFrame:
    """Days above the highest or below the lowest value of the window before."""
    base = daily.withColumns(
        {
            "prior_max": rolled(value, window, "max", least, 1),
            "prior_min": rolled(value, window, "min", least, 1),
        }
    ).where(F.col(value).isNotNull() & F.col("prior_max").isNotNull())
    beyond = lambda edge: F.when(
        F.abs(edge) >= 1e-9, (F.col(value) - F.col(edge)) / F.abs(edge) * 100
    )
    return base.withColumns(
        {"pct_above_max": beyond("prior_max"), "pct_below_min": beyond("prior_min")}
    ).withColumns(
        {
            "new_high": F.col(value) > F.col("prior_max"),
            "new_low": F.col(value) < F.col("prior_min"),
            "large_high": yes(F.col("pct_above_max") >= pct),
            "large_low": yes(F.col("pct_below_min") <= -pct),
        }
    )


def breakout_summary(days: DataFrame) -> DataFrame:
    """Counts of breakouts."""
    flags = ["new_high", "new_low", "large_high", "large_low"]
    return days.agg(F.count("*").alias("valid_days"), *[F.count_if(f).alias(f) for f in flags])


def anomaly_features(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Yesterday's anomaly flags and rolling score for every day."""
    scored = rolling_anomalies(global_anomalies(daily, value), value)
    order = Window.orderBy("date")
    before = lambda c: F.lag(c).over(order)
    return scored.select(
        "date",
        yes(before("global_high")).alias("is_spike_lag"),
        yes(before("global_low")).alias("is_drop_lag"),
        yes(before("global_anomaly")).alias("is_anomaly_lag"),
        before("z_30").alias("rolling_z_lag"),
        yes(before("high_30")).alias("rolling_high_lag"),
        yes(before("low_30")).alias("rolling_low_lag"),
    )
