"""The HAVING change log of a stream, kept up batch by batch."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidemark.operators.having import transitions
from tidemark.session import exists, publish
from tidemark.streaming.state import Totals


def log_path(path: str) -> str:
    """Where a `HavingLog` of this path keeps its result."""
    return f"{path}/log"


@dataclass(frozen=True)
class HavingLog:
    """``SELECT key, sum(value) ... HAVING sum(value) > bound`` as a change log.

    Use `step` as a foreachBatch function on the stream of changes; the result
    is appended to ``path/log/batch=i``.
    """

    path: str
    key: str
    value: Column
    bound: float
    name: str = "sum_qty"
    compact_every: int = 16

    @property
    def log_path(self) -> str:
        return log_path(self.path)

    @property
    def totals(self) -> Totals:
        return Totals(self.path, [self.key], {self.name: self.value}, self.compact_every)

    def step(self, batch: DataFrame, number: int) -> None:
        if not exists(batch.sparkSession, f"{self.log_path}/batch={number}"):
            sums = self.totals.add(batch, number)
            path = self.totals.before(sums, number).unionByName(sums)
            changes = transitions(path, self.key, self.bound, self.name)
            # What was there before the batch has been reported before.
            publish(changes.where("epoch >= 0"), self.log_path, f"batch={number}")
        self.totals.compact(batch.sparkSession, number)
