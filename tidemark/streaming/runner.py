"""Starting streams with the right state settings, sinks, and per-batch timings."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.operators.zset import as_rows, snapshot
from tidemark.session import SHUFFLES_GO, publish, settings
from tidemark.sources.jdbc import Database

# Join state keeps every change, so it must be able to outgrow memory.  On disk it is there
# twice, in the executors' folders and in the checkpoint: as RocksDB's files, compressed, each
# uploaded once, without a log of the changes beside them.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    # Files of older states go; a restart needs the last two batches alone.
    "spark.sql.streaming.minBatchesToRetain": "2",
}
# For `start`: state rows are not counted.  A count looks up every key before it is put.
UNCOUNTED = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def start(stream: DataFrame, checkpoint: str, name: str, to: Callable, available_now: bool = False,
          state_partitions: int | None = None, every: str | None = None,
          options: dict[str, str] | None = None) -> StreamingQuery:
    """Start a streaming query; `to` gets the writer and sets its sink.

    The number of state partitions is fixed by a checkpoint's first run.  Unless
    it is given, a local session takes one per core; a cluster, whose cores may
    come and go, the session's ``spark.sql.shuffle.partitions``.  `options` are
    session settings for this query alone.
    """
    spark = stream.sparkSession
    parts = state_partitions or _state_partitions(spark)
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    # A batch's shuffles go with it, not when the driver next collects its garbage.
    own = {**STATE_STORE, SHUFFLES_GO: "true", "spark.sql.shuffle.partitions": str(parts), **(options or {})}
    with settings(spark, own):
        return to(writer).start()


def _state_partitions(spark: SparkSession) -> int:
    if spark.sparkContext.master.startswith("local"):
        return spark.sparkContext.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def to_parquet(path: str, *partition: str) -> Callable:
    """Append to a folder; a file counts once its batch is committed."""
    return lambda writer: writer.outputMode("append").format("parquet").option("path", path).partitionBy(*partition)


def to_text(path: str) -> Callable:
    """Append a single text column to a folder."""
    return lambda writer: writer.outputMode("append").format("text").option("path", path)


def to_console(show: Callable[[str], None] = print) -> Callable:
    """Print every row of each batch; the driver holds one partition at a time."""
    def step(batch: DataFrame, number: int) -> None:
        show(f"batch {number}: {', '.join(batch.columns)}")
        print_rows(batch, show)

    return to_batches(step)


def print_rows(df: DataFrame, show: Callable[[str], None] = print) -> None:
    """Print all rows, tab-separated."""
    for row in df.toLocalIterator():
        show("\t".join("" if value is None else str(value) for value in row))


def to_batches(step: Callable[[DataFrame, int], None]) -> Callable:
    return lambda writer: writer.foreachBatch(step)


def to_database(database: Database, table: str, log_path: str) -> Callable:
    """Keep a database table equal to the netted log.

    Each batch is written to the log first, under its number; the table is then
    replaced by the snapshot, so a batch that is run twice changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        publish(batch, log_path, f"batch={number}")
        log = spark.read.parquet(log_path).drop("batch")
        database.replace(as_rows(snapshot(log)), table)

    return to_batches(step)


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for an available-now query and pass on its failure."""
    query.awaitTermination()
    return query


TIMINGS = "batch bigint, ms bigint, input_rows bigint, state_rows bigint"


class Timings(StreamingQueryListener):
    """Writes duration, input rows and state rows of every batch to a folder, a row per batch."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        if progress["name"] == self.name:
            row = (progress["batchId"], progress["batchDuration"], progress["numInputRows"],
                   sum(s["numRowsTotal"] for s in progress["stateOperators"]))
            # A batch without input may report again under its number.
            self.spark.createDataFrame([row], TIMINGS).coalesce(1).write.mode("append").parquet(self.path)


def epoch_timings(spark: SparkSession, path: str) -> DataFrame:
    """What `Timings` has written: one row for each batch, however many there were."""
    rows = spark.read.schema(TIMINGS).parquet(path)
    return rows.groupBy("batch").agg(*[F.max(c).alias(c) for c in ("ms", "input_rows", "state_rows")])
