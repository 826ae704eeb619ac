"""`operators.support.presence` over a stream, from one count per key.

Only keys whose support leaves or reaches zero are written, so a join behind it moves
no row for a key that merely gains or loses one of many.  Batches come in epoch order;
an epoch may be split over batches, and then a key that leaves in one and is back in
the next is written twice, with opposite signs: the log, netted, is right.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.support import crossing
from tidemark.operators.zset import signed_sum
from tidemark.session import exists, publish
from tidemark.streaming.kept import KeptTable


@dataclass(frozen=True)
class SupportLog:
    """Presence of the keys of `schema`; use `step` as a foreachBatch function.

    The log is ``path/log/batch=i``.  The table holds keys with support alone.
    """

    path: str
    schema: StructType

    @property
    def table(self) -> KeptTable:
        schema = StructType([*self.schema.fields, StructField("n", LongType())])
        return KeptTable(f"{self.path}/support", self.schema.names, schema)

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def step(self, batch: DataFrame, number: int) -> None:
        spark, table, keys = batch.sparkSession, self.table, self.schema.names
        touched = table.touched(batch)
        before = table.read(spark, number - 1, touched)
        if not exists(spark, f"{self.log_path}/batch={number}"):
            along = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # Support so far stands before all epochs; keys without a change come no further than the window.
            counts = signed_sum(batch, keys, {}, by_epoch=True).withColumn("old", F.lit(False))
            counts = counts.unionByName(before.withColumns({"epoch": F.lit(-1), "old": F.lit(True)}))
            moved = counts.withColumn("support", F.sum("n").over(along)).where("NOT old")
            moved = moved.select(crossing("support", "n").alias("w"), "epoch", *keys).where("w <> 0")
            publish(moved, self.log_path, f"batch={number}")
        added = signed_sum(batch, keys, {})
        now = before.unionByName(added).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        table.write(now, touched, number)
