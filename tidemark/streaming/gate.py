"""Logs of several sources that show an epoch once all of them have finished it.

Each source ends its epochs with marks, changes of weight 0 that come after all rows of
the epoch.  What a source has brought waits in its own folder; a manifest tells which
epoch it has finished.  `release` takes the epochs that the slowest source has passed,
works out their results and shows them all at once, so that no reader meets an epoch
of which one source is still to come.

A release reads the new epochs' folders and the rows open before them, not the log from
its beginning.  It is written down as a plan first: one that was lost half way goes on
with the same epochs, however far the sources have come since.  Once it is done, the
history has its rows and their folders go.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tidemark.operators.history import FROM
from tidemark.session import exists, make_folder, publish, remove_all
from tidemark.streaming.history import History


def marked(log: DataFrame, epoch: int) -> DataFrame:
    """A source's changes of an epoch, with the mark that it is whole."""
    mark = log.sparkSession.range(1).select(F.lit(0).alias("w"), F.lit(epoch).alias("epoch"))
    return log.unionByName(mark, allowMissingColumns=True)


@dataclass(frozen=True)
class EpochGate:
    """Sources by name, with the schema of their rows (without ``w`` and ``epoch``).

    A row that comes after its epoch's mark is kept from the results and put in
    ``path/late/<source>``; `late` gives them.
    """

    path: str
    sources: dict[str, StructType]

    def take(self, source: str) -> Callable[[DataFrame, int], None]:
        """The foreachBatch function of one source's stream."""
        names = ["w", *self.sources[source].names, "epoch"]

        def step(batch: DataFrame, number: int) -> None:
            passed = self._finished(batch.sparkSession, source, number)
            rows = batch.where("w <> 0").select(*names)
            publish(rows.where(F.col("epoch") > passed), f"{self.path}/rows/{source}", f"batch={number}", ("epoch",))
            publish(rows.where(F.col("epoch") <= passed), f"{self.path}/late/{source}", f"batch={number}")
            # Only when its rows are there may a source call an epoch finished.
            mark = batch.where("w = 0").agg(F.coalesce(F.max("epoch"), F.lit(passed)).cast("int").alias("finished"))
            publish(mark.select(F.greatest("finished", F.lit(passed)).alias("finished")), f"{self.path}/finished/{source}", f"batch={number}")

        return step

    def finished(self, spark: SparkSession) -> dict[str, int]:
        """The last epoch each source has finished, -1 for none."""
        return {source: self._finished(spark, source) for source in self.sources}

    def released(self, spark: SparkSession) -> int:
        """The last epoch whose result is shown, -1 for none."""
        return self._plan(spark, self._releases(spark) - 1)

    def release(self, spark: SparkSession, result: Callable[[dict[str, DataFrame], int], DataFrame]) -> int:
        """Show the epochs that all sources have finished since; gives the last epoch shown.

        `result` gets each source's log, where all that was before the new epochs is one
        epoch, and the last epoch; of what it gives, the new epochs count.
        """
        number = self._releases(spark)
        before, complete = self._plan(spark, number - 1), min(self.finished(spark).values())
        if not exists(spark, f"{self.path}/plans/number={number}"):
            if complete <= before:
                return before
            plan = spark.range(1).select(F.lit(complete).cast("int").alias("upto"))
            publish(plan, f"{self.path}/plans", f"number={number}")
        complete = self._plan(spark, number)
        new = {source: self._rows(spark, source, before, complete) for source in self.sources}
        logs = {}
        for source, schema in self.sources.items():
            still = self._history(source).table.read(spark, number - 1).withColumn("epoch", F.lit(before)).drop(FROM)
            logs[source] = still.unionByName(new[source]).select("w", "epoch", *schema.names)
        fresh = result(logs, complete).where(F.col("epoch") > before)
        publish(fresh, f"{self.path}/results", f"release={number}", ("epoch",))
        for source in self.sources:
            self._history(source).step(new[source], number)
        publish(spark.range(1), f"{self.path}/released", f"number={number}")
        self._forget(spark, before, complete)
        return complete

    def _forget(self, spark: SparkSession, after: int, upto: int) -> None:
        """Delete what the sources brought of released epochs; what still comes of them is late."""
        for source in self.sources:
            for epoch in range(after + 1, upto + 1):
                remove_all(spark, f"{self.path}/rows/{source}/batch=*/epoch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The results of all epochs shown."""
        return spark.read.parquet(f"{self.path}/results").drop("release")

    def as_of(self, spark: SparkSession, source: str, epoch: int) -> DataFrame:
        """A source's table at an epoch that is shown."""
        return self._history(source).as_of(spark, self._releases(spark) - 1, epoch)

    def late(self, spark: SparkSession, source: str) -> DataFrame:
        schema = StructType().add("w", IntegerType())
        for field in self.sources[source]:
            schema = schema.add(field)
        return spark.read.schema(schema.add("epoch", IntegerType())).parquet(make_folder(spark, f"{self.path}/late/{source}"))

    def _history(self, source: str) -> History:
        return History(f"{self.path}/history/{source}", self.sources[source])

    def _rows(self, spark: SparkSession, source: str, after: int, upto: int) -> DataFrame:
        """What a source brought of some epochs; other epochs' folders stay unread."""
        schema = StructType().add("w", IntegerType())
        for field in self.sources[source]:
            schema = schema.add(field)
        schema = schema.add("batch", LongType()).add("epoch", IntegerType())
        rows = spark.read.schema(schema).parquet(make_folder(spark, f"{self.path}/rows/{source}"))
        return rows.where((F.col("epoch") > after) & (F.col("epoch") <= upto)).drop("batch")

    def _finished(self, spark: SparkSession, source: str, before: int | None = None) -> int:
        """One number, from a row per batch; maybe as it was before a batch."""
        rows = spark.read.schema("finished int, batch bigint").parquet(make_folder(spark, f"{self.path}/finished/{source}"))
        top = (rows if before is None else rows.where(F.col("batch") < before)).agg(F.max("finished")).first()[0]
        return -1 if top is None else top

    def _plan(self, spark: SparkSession, number: int) -> int:
        if number < 0:
            return -1
        return spark.read.schema("upto int").parquet(f"{self.path}/plans/number={number}").first()[0]

    def _releases(self, spark: SparkSession) -> int:
        """How many releases are done."""
        top = spark.read.schema("id bigint, number int").parquet(make_folder(spark, f"{self.path}/released")).agg(F.max("number")).first()[0]
        return 0 if top is None else top + 1
