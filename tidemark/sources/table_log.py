"""Change logs kept as parquet, one folder per table and epoch, and logs of tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.schemas import INT, KEY, TABLES, TEXT, canonical
from tidemark.session import publish, remove


def changes_of_table(table: DataFrame, tag: str, changes: list[tuple[int, int, Column]]) -> DataFrame:
    """The log that inserts all rows of `table` in epoch 0 and then changes some.

    `changes` lists ``(epoch, weight, which rows)``.  The table is read once,
    each row giving as many changes as apply to it.
    """
    every = [F.struct(F.lit(0).alias("epoch"), F.lit(1).alias("w"))] + [
        F.when(which, F.struct(F.lit(epoch).alias("epoch"), F.lit(w).alias("w")))
        for epoch, w, which in changes
    ]
    # Typed once per row, before a row becomes several changes.
    rows = canonical(table, tag)
    log = rows.select(F.explode(F.array(*every)).alias("change"), *rows.columns)
    return log.where(F.col("change").isNotNull()).select("change.w", "change.epoch", *rows.columns)


def changes_in_epoch(table: DataFrame, tag: str, changes: list[tuple[int, int, Column]], epoch: int) -> DataFrame:
    """One epoch of `changes_of_table`, reading only the rows that change in it."""
    chosen = [(1, F.lit(True))] if epoch == 0 else []
    chosen += [(w, which) for at, w, which in changes if at == epoch]
    parts = [canonical(table.where(which).withColumn("w", F.lit(w)), tag) for w, which in chosen]
    log = parts[0] if parts else canonical(table.limit(0).withColumn("w", F.lit(1)), tag)
    for part in parts[1:]:
        log = log.unionByName(part)
    return log.withColumn("epoch", F.lit(epoch))


def write_epoch(log: DataFrame, path: str, epoch: int) -> None:
    """Write one epoch's changes to ``path/epoch=N``, replacing an earlier try.

    They appear at once: a stream that runs meanwhile takes them in one batch.
    """
    rows = log.where(F.col("epoch") == epoch).drop("epoch")
    remove(log.sparkSession, f"{path}/epoch={epoch}")
    publish(rows, path, f"epoch={epoch}")


def log_schema(tag: str) -> StructType:
    schema = StructType().add("w", INT)
    for field in TABLES[tag]:
        schema = schema.add(field)
    return schema.add("epoch", INT)


def read_log(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A table's log; a filter on ``epoch`` reads only the folders it needs."""
    return spark.read.schema(log_schema(tag)).parquet(path)


def stream_log(spark: SparkSession, path: str, tag: str, files_per_batch: int | None = None) -> DataFrame:
    """`read_log` as a stream that takes up new files as they come."""
    return with_place(_stream(spark, log_schema(tag), path, files_per_batch))


def with_place(rows: DataFrame) -> DataFrame:
    """Add where each row stands in its file, which no two rows share."""
    return rows.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place"))


def _stream(spark: SparkSession, schema: StructType, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# --- logs routed out of text ------------------------------------------------
# One dataset for all tables, ``batch=i/tag=t/epoch=e``: a text log is read and
# written once, and a reader of one table opens only that table's folders.


def _routed_schema() -> StructType:
    schema = StructType().add("w", INT).add("seq", KEY)
    for tag, fields in TABLES.items():
        schema = schema.add(tag, fields)
    schema = schema.add("reason", TEXT).add("value", TEXT)
    return schema.add("batch", KEY).add("tag", TEXT).add("epoch", INT)


def read_routed(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return _routed_table(spark.read.schema(_routed_schema()).parquet(path), tag)


def stream_routed(spark: SparkSession, path: str, tag: str, files_per_batch: int | None = None) -> DataFrame:
    rows = with_place(_stream(spark, _routed_schema(), path, files_per_batch))
    return _routed_table(rows, tag)


def _routed_table(rows: DataFrame, tag: str) -> DataFrame:
    rows = rows.where(F.col("tag") == tag)
    own = ["reason", "value"] if tag == "quarantine" else [f"{tag}.*"]
    place = ["place"] if "place" in rows.columns else []
    return rows.select("w", "epoch", "seq", *own, *place)
