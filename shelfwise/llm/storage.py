"""Tables written to the shared scratch folder of a session, which cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.session import scratch_folder

_roots: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The scratch folder of this application."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = scratch_folder(spark)
    return _roots[app]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared scratch folder and read back: later steps prune its columns."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> int:
    """How many tables :func:`stored` has written for this application and not deleted."""
    return len(_paths.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written after the first ``since``, but for the last ``keep``: nothing may read them any more."""
    paths = _paths.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - keep]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    paths[:] = [p for p in paths if p not in gone]
