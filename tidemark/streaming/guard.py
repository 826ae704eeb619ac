"""Keeping deletes of absent rows out of a stream.

A row deleted more often than inserted would carry a negative weight into a
join, where two such rows make a positive pair.  The guarded log never lets a
row's weight fall below zero; a delete that came too early is settled against
the insert that follows.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.zset import floored
from tidemark.session import exists, publish
from tidemark.streaming.state import Totals


@dataclass(frozen=True)
class GuardedLog:
    """The changes of a stream with every row's net weight held at zero or above.

    Use `step` as a foreachBatch function; the log is appended to
    ``path/log/batch=i``.  `identity` names the columns that make a row.
    """

    path: str
    identity: list[str]
    compact_every: int = 16

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    @property
    def totals(self) -> Totals:
        return Totals(self.path, self.identity, {}, self.compact_every)

    def step(self, batch: DataFrame, number: int) -> None:
        if not exists(batch.sparkSession, f"{self.log_path}/batch={number}"):
            sums = self.totals.add(batch, number)
            path = self.totals.before(sums, number).unionByName(sums)
            publish(floored(path, self.identity).where("epoch >= 0"), self.log_path, f"batch={number}")
        self.totals.compact(batch.sparkSession, number)

    def orphans(self, spark: SparkSession, number: int) -> DataFrame:
        """Rows that batch `number` leaves deleted more often than inserted."""
        return self.totals.totals(spark, number).where("n < 0")
