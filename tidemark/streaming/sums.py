"""The signed sums of a stream, per key and epoch: what a linear query needs of its many side."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.zset import signed_sum
from tidemark.session import publish


@dataclass(frozen=True)
class SumLog:
    """``n`` and weighted sums per key and epoch of each batch, in ``path/log/batch=i``.

    Use `step` as a foreachBatch function.  A key's rows of a batch are added up
    before the shuffle, so a heavy key is one partial sum per task.
    """

    path: str
    keys: list[str]
    sums: dict[str, Column]

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def step(self, batch: DataFrame, number: int) -> None:
        publish(signed_sum(batch, self.keys, self.sums, by_epoch=True), self.log_path, f"batch={number}")

    def stream(self, spark: SparkSession) -> DataFrame:
        """The log as a stream; wants its first batch to be there."""
        schema = spark.read.parquet(self.log_path).schema
        return spark.readStream.schema(schema).parquet(self.log_path).drop("batch")
