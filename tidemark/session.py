"""Where a job may write, and session settings that hold for one call."""

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of an Arrow batch that goes to Python, but for a single row of more.
BATCH_BYTES = 8 << 20
#: Most that a task reads of files (or a row group, if that is more) and of merged shuffle
#: partitions where it holds all of it in memory, as rows many times as large.
SMALL_TASKS = {
    "spark.sql.files.maxPartitionBytes": str(8 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 << 20),
}

#: Whether Spark deletes a query's shuffle files at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session may leave the setting out; it then gets a folder of
    this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the work folder: computed once, whatever reads it.

    What was shuffled for it goes as soon as it is there, not when the driver next
    collects its garbage.
    """
    path = work_dir(df.sparkSession, name)
    with settings(df.sparkSession, {SHUFFLES_GO: "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def prepare(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split heavy keys of joins that feed an aggregate, and bound Arrow batches.

    Without the first it keeps such a join whole, to save the aggregate a shuffle,
    and one key with a third of the rows stays in one task.  Without the second a
    batch is 10,000 rows, whatever their size.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Set session options for the length of a block."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def publish(df: DataFrame, folder: str, name: str, partitions: tuple[str, ...] = (), text: bool = False) -> None:
    """Write `df` as ``folder/name``, which appears whole or not at all.

    It is written aside and then renamed, so a reader that takes files as they
    come never sees those of a write that was lost half way.  A folder that is
    there already stays as it is: running a batch again gives no new files.
    What was shuffled for it goes with the write.
    Wants a file system whose rename of a folder is atomic, as HDFS's is.
    Rows of one of the `partitions` go to one file, or some if they are many.  With
    `text` they are lines, dealt to tasks as `df` has them.
    """
    spark, target = df.sparkSession, f"{folder}/{name}"
    if exists(spark, target):
        return
    aside = f"{folder}/_aside/{name}"
    rows = df.hint("rebalance", *partitions) if partitions and not text else df
    with settings(spark, {SHUFFLES_GO: "true"}):
        rows.write.mode("overwrite").partitionBy(*partitions).format("text" if text else "parquet").save(aside)
    system, own = _located(spark, aside)
    if not system.rename(own, _located(spark, target)[1]):
        raise OSError(f"{aside} could not be renamed")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether `path` exists on its own file system."""
    system, own = _located(spark, path)
    return system.exists(own)


def make_folder(spark: SparkSession, path: str) -> str:
    """`path`, as a folder that is there, so that a stream may wait for its first file."""
    system, own = _located(spark, path)
    system.mkdirs(own)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own that nothing refers to any more."""
    system, own = _located(spark, path)
    system.delete(own, True)


def remove_all(spark: SparkSession, pattern: str) -> None:
    """`remove` of every folder a pattern fits."""
    system, own = _located(spark, pattern)
    for found in system.globStatus(own) or []:
        system.delete(found.getPath(), True)


def _located(spark: SparkSession, path: str):
    """The file system of a path, and the path on it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own
