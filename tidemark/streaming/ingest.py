"""Taking a text log with epoch markers into a routed parquet log, batch by batch."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import exists, publish
from tidemark.sources.text_log import (
    data_lines, number_lines, parse, routed, summarize_splits, with_position,
)
from tidemark.streaming.runner import start, to_batches

# Typing the fields of four tables makes one generated method too long for the
# JIT compiler; beyond this many bytes Spark splits the code instead.
SHORT_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str,
           files_per_batch: int | None = None, available_now: bool = True,
           on_unknown: str = "quarantine", state_partitions: int | None = None) -> StreamingQuery:
    """Read the files of `source` as they come and write ``target/batch=i``.

    Epochs and line numbers go on from batch to batch; the counters are kept
    next to the data, in ``target/_counters``.  `on_unknown` is what to do with
    records of an unknown table, as in `text_log.quarantine`.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = with_position(reader.text(source))

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if exists(session, f"{target}/batch={number}"):
            return
        epoch, seq = _counters(session, target, number - 1)
        splits = summarize_splits(batch, epoch, seq)
        splits.agg(
            F.coalesce(F.max(F.col("epoch0") + F.size("marks")), F.lit(epoch)).alias("epoch"),
            F.coalesce(F.max(F.col("seq0") + F.col("n")), F.lit(seq)).alias("seq"),
        ).write.mode("overwrite").parquet(_counter_path(target, number))
        records = parse(data_lines(number_lines(batch, splits)))
        publish(routed(records, on_unknown), target, f"batch={number}", partitions=("tag", "epoch"))

    return start(lines, checkpoint, "ingest", to_batches(step), available_now, state_partitions, options=SHORT_METHODS)


def _counter_path(target: str, number: int) -> str:
    return f"{target}/_counters/batch={number}"


def _counters(spark: SparkSession, target: str, number: int) -> tuple[int, int]:
    if number < 0:
        return 0, 0
    row = spark.read.parquet(_counter_path(target, number)).first()
    return row["epoch"], row["seq"]
