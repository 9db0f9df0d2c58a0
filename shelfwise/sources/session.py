"""Session settings the operators rely on."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger(__name__)
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
#: Bytes of files or of shuffled rows that a task of the shop's queries gets at most, and the partitions of a shuffle
#: before AQE joins small ones: hash tables and sorts of a task then stay as they are when tables grow.
TASK_BYTES, PARTITIONS = 16 << 20, 400
SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
#: Bytes of an Arrow batch at most where wide rows go to Python: rows of texts or points are then not held by the ten thousand,
#: neither in buffers outside the heap nor in Python.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("shelfwise")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created, and say which ones changed."""
    for key, value in SETTINGS.items():
        found = spark.conf.get(key, None)
        if found != value:
            spark.conf.set(key, value)
            LOG.warning("%s was %s, now %s: results rest on it", key, found, value)
    return spark


def size_bytes(text: str) -> int:
    """The bytes of a size setting such as ``64m``; a plain number is bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bounded_tasks(spark: SparkSession) -> SparkSession:
    """Cut files and shuffles finely enough that the memory of a task doesn't grow with the tables.

    A partial aggregate over nearly unique keys, or a sort, holds a multiple of what its task reads. Settings that cut
    finer already stay.
    """
    for key in SIZES:
        if size_bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, TASK_BYTES)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    found = spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if int(found) < PARTITIONS:
        spark.conf.set(key, PARTITIONS)
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Cut the Arrow batches that tasks give to Python by their bytes; a finer setting stays."""
    if size_bytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder all executors can reach, for files written and read back."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/shelfwise-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="shelfwise-files-")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a scratch folder and read back, for rows that several steps of a query read."""
    path = f"{scratch_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
