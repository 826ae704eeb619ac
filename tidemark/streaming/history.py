"""A change log kept as intervals, so that a past epoch is read without the log.

Rows whose interval is open lie in a kept table; a batch rewrites the buckets it
touches.  Intervals that end are appended in ``path/closed/batch=i/valid_until=e`` and
never change.  A reader of epoch e takes the folders that end after e, and of these and
the open rows what begins by then: Spark prunes the one by folder, the other by the
files' statistics.

Batches come in the log's order: no row of a batch is of an earlier epoch than one of an
earlier batch.  An epoch may be split over batches.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tidemark.operators.history import FROM, UNTIL, as_of, free_names, intervals
from tidemark.session import publish
from tidemark.streaming.kept import KeptTable


@dataclass(frozen=True)
class History:
    """The intervals of rows of `schema`; use `step` as a foreachBatch function.

    A row that was deleted before it came is kept with its negative weight until the
    insert comes.  Columns named like an interval's raise ValueError.
    """

    path: str
    schema: StructType

    def __post_init__(self):
        free_names(self.schema.names)

    @property
    def table(self) -> KeptTable:
        schema = StructType([*self.schema.fields]).add("w", LongType()).add(FROM, IntegerType())
        return KeptTable(f"{self.path}/open", self.schema.names, schema)

    @property
    def closed_path(self) -> str:
        return f"{self.path}/closed"

    def step(self, batch: DataFrame, number: int) -> None:
        names, table = self.schema.names, self.table
        touched = table.touched(batch)
        before = table.read(batch.sparkSession, number - 1, touched)
        # An open row is a change at its begin: what the batch adds to that epoch joins it.
        changes = batch.select(F.col("w").cast("long").alias("w"), F.col("epoch").cast("int").alias("epoch"), *names)
        spans = intervals(changes.unionByName(before.withColumnRenamed(FROM, "epoch")))
        ended = spans.where(F.col(UNTIL).isNotNull() & (F.col("w") > 0))
        publish(ended.select("w", FROM, *names, UNTIL), self.closed_path, f"batch={number}", (UNTIL,))
        table.write(spans.where(F.col(UNTIL).isNull() & (F.col("w") != 0)).drop(UNTIL), touched, number)

    def closed(self, spark: SparkSession, number: int) -> DataFrame:
        """The intervals that ended up to batch `number`; later ones are still open for its reader."""
        schema = StructType([*self.table.schema.fields]).add(UNTIL, IntegerType()).add("batch", LongType())
        rows = spark.read.schema(schema).parquet(self.closed_path)
        return rows.where(F.col("batch") <= number).drop("batch")

    def as_of(self, spark: SparkSession, number: int, epoch: int) -> DataFrame:
        """The rows at the end of `epoch`, one of those that batch `number` or an earlier one brought."""
        still = self.table.read(spark, number).withColumn(UNTIL, F.lit(None).cast("int"))
        return as_of(self.closed(spark, number), epoch).unionByName(as_of(still, epoch))
