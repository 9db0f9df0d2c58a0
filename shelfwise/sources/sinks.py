"""Metric, forecast and stage sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.scalars import ratio


def publish(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], None] = lambda folder: None) -> None:
    """Write into a folder beside ``path``, check what can be read back there, and only then put it in the place of ``path``.

    If the write or the check raises, what was at ``path`` stays as it is. Readers see the old or the new folder, or for the
    moment between two renames none.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = lambda what: jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{what}-{uuid.uuid4().hex}")
    staging, old = beside("new"), beside("old")
    files = target.getFileSystem(conf)
    try:
        write(staging.toString())
        check(staging.toString())
    except BaseException:
        files.delete(staging, True)
        raise
    replaced = files.exists(target)
    if replaced and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(staging, target):
        if replaced:
            files.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if replaced:
        files.delete(old, True)


def write_metrics(df: DataFrame, path: str, fmt: str = "csv", one_file: bool = False) -> None:
    """Write a metric table; ``one_file`` is for small report tables only."""

    def write(folder: str) -> None:
        writer = (df.coalesce(1) if one_file else df).write
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(folder)

    publish(df.sparkSession, path, write)


def forecast_summary(forecast: DataFrame, template: DataFrame) -> DataFrame:
    """Counts that tell whether a forecast may be written, in one row."""
    extra = forecast.join(template, "date", "left_anti").agg(F.count("*").alias("n")).scalar()
    absent = template.join(forecast, "date", "left_anti").agg(F.count("*").alias("n")).scalar()
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    share = ratio(F.col("cogs"), F.col("revenue"))
    return forecast.agg(
        F.count("*").alias("rows"),
        F.count_distinct("date").alias("days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(bad("revenue") | bad("cogs")).alias("missing"),
        F.count_if((F.col("revenue") < 0) | (F.col("cogs") < 0)).alias("negative"),
        F.count_if(F.col("cogs") > F.col("revenue")).alias("cogs_above_revenue"),
        F.avg("revenue").alias("revenue_mean"),
        F.avg("cogs").alias("cogs_mean"),
        F.max(share).alias("max_cogs_share"),
    ).withColumns({"extra_dates": extra, "absent_dates": absent})


def write_forecast(forecast: DataFrame, template: DataFrame, path: str, one_file: bool = False) -> DataFrame:
    """Write a checked forecast as CSV in the order of its dates and return the summary row of the file.

    Negative values become 0 and values are rounded to cents. What can be read back is checked: with missing values or
    dates that differ from the template it is refused, and an earlier file stays.
    """
    spark = forecast.sparkSession
    money = lambda c: F.when(F.col(c).isNotNull(), F.round(F.greatest(c, F.lit(0.0)), 2))
    ready = forecast.select("date", money("revenue").alias("revenue"), money("cogs").alias("cogs")).orderBy("date")
    dated = ready.withColumn("date", F.date_format("date", "yyyy-MM-dd"))

    def summary(folder: str) -> DataFrame:
        return forecast_summary(spark.read.csv(folder, schema="date DATE, revenue DOUBLE, cogs DOUBLE", header=True), template)

    def check(folder: str) -> None:
        row = summary(folder).first()
        if row.missing:
            raise ValueError(f"{row.missing} forecast rows have missing values")
        if row.extra_dates or row.absent_dates or row.rows != row.days:
            raise ValueError("forecast dates differ from the template")

    publish(spark, path, lambda folder: (dated.coalesce(1) if one_file else dated).write.csv(folder, header=True), check)
    return summary(path)


def stage_problem(df: DataFrame, columns: Sequence[str], keys: Sequence[str], days: DataFrame) -> str | None:
    """Why a stored stage cannot be used, or None.

    ``days`` holds the expected ``keys`` (for example fold and date); they must match
    exactly and no listed column may be null.
    """
    absent = [c for c in [*keys, *columns] if c not in df.columns]
    if absent:
        return f"missing columns {absent}"
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))).alias("nulls"),
    ).first()
    expected = days.select(*keys)
    if row.n != expected.count():
        return f"{row.n} rows"
    if not expected.join(df, list(keys), "left_anti").isEmpty():
        return "key sequence differs"
    return f"{row.nulls} rows with nulls" if row.nulls else None


def cached_stage(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    columns: Sequence[str],
    keys: Sequence[str],
    days: DataFrame,
    refresh: bool = False,
    partition_by: Sequence[str] = (),
) -> tuple[DataFrame, str]:
    """Stored stage when it is complete, else build, check and store it; a stage that fails its check replaces nothing."""
    if not refresh:
        try:
            stored = spark.read.parquet(path)
            if stage_problem(stored, columns, keys, days) is None:
                return stored, "loaded"
        except AnalysisException:
            pass

    def check(folder: str) -> None:
        problem = stage_problem(spark.read.parquet(folder), columns, keys, days)
        if problem:
            raise ValueError(f"stage {path} is not valid: {problem}")

    publish(spark, path, lambda folder: build().write.partitionBy(*partition_by).parquet(folder), check)
    return spark.read.parquet(path), "recomputed"
