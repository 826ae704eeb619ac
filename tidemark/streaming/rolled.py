"""Text files that are rolled by size, age and idleness.

Batches wait as they come, each under its number.  Once what waits is large, old or has
not grown for long enough, it is packed into files: none is larger than the limit, and
only the last of a roll may be smaller than three quarters of it.  A manifest row per
file tells its lines and bytes; a roll counts when its manifest is there.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.session import exists, make_folder, publish, remove, written

_ARRIVED = "lines bigint, bytes bigint, at double, batch bigint"
#: A line of more than this part of the limit is a file of its own.
_LONG = 8


def _binned(rows: DataFrame, most_bytes: int) -> DataFrame:
    """``(value, bin, at)``: consecutive lines that fill a file together.

    A line's place in bytes is the sum of the partitions before its own, a row each, and
    of the lines before it in that.
    """
    size = F.octet_length("value") + 1
    numbered = rows.select("value", size.cast("long").alias("size"), F.spark_partition_id().alias("part"),
                           F.monotonically_increasing_id().alias("at"))
    # Written, as the numbers of a second run need not be the same.
    numbered = written(numbered, "rolled")
    short = numbered.where(F.col("size") <= most_bytes // _LONG)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = short.groupBy("part").agg(F.sum("size").alias("total"))
    bases = bases.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    along = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.col("base") + F.col("before") - F.col("size")
    room = F.lit(most_bytes - most_bytes // _LONG)
    packed = short.withColumn("before", F.sum("size").over(along)).join(bases, "part")
    packed = packed.select("value", F.floor(begin / room).cast("long").alias("bin"), "at")
    own = numbered.where(F.col("size") > most_bytes // _LONG).select("value", (-1 - F.col("at")).alias("bin"), "at")
    return packed.unionByName(own)


@dataclass(frozen=True)
class RolledOutput:
    """The lines of a stream in ``path/parts/roll=n/bin=k``, a file each; use `step` as a foreachBatch function.

    Batches have one text column `value`; NULL is an empty line.  Repeated lines stay.  A
    line of more than an eighth of `most_bytes` gets a file of its own, even one above it.
    As no batch comes while a stream is idle, call `roll` now and then beside it.
    """

    path: str
    most_bytes: int = 128 << 20
    most_age: float = 900.0
    most_idle: float = 300.0
    clock: Callable[[], float] = time.time

    def step(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # A batch that is run again may be rolled already.
        if number > self._upto(spark, self._rolls(spark) - 1):
            publish(batch.select(F.coalesce("value", F.lit("")).alias("value")), f"{self.path}/open", f"batch={number}")
            rows = spark.read.schema("value string").parquet(f"{self.path}/open/batch={number}")
            arrived = rows.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
            publish(arrived.withColumn("at", F.lit(self.clock())), f"{self.path}/arrived", f"batch={number}")
        self.roll(spark)

    def roll(self, spark: SparkSession, now: bool = False) -> bool:
        """Pack what waits if it is due, or in any case; tells whether it did."""
        number = self._rolls(spark)
        after = self._upto(spark, number - 1)
        if not exists(spark, f"{self.path}/plans/number={number}"):
            arrived = spark.read.schema(_ARRIVED).parquet(make_folder(spark, f"{self.path}/arrived")).where(F.col("batch") > after)
            waiting = arrived.where("lines > 0").agg(
                F.sum("bytes").alias("bytes"), F.min("at").alias("oldest"), F.max("at").alias("newest"), F.max("batch").alias("upto")).first()
            if waiting["bytes"] is None or not (now or self._due(waiting)):
                return False
            publish(spark.range(1).select(F.lit(waiting["upto"]).alias("upto")), f"{self.path}/plans", f"number={number}")
        upto = self._upto(spark, number)
        if not exists(spark, f"{self.path}/parts/roll={number}"):
            rows = spark.read.schema("value string, batch bigint").parquet(f"{self.path}/open")
            rows = rows.where((F.col("batch") > after) & (F.col("batch") <= upto)).select("value")
            # All lines of a file in one task, in their order.
            rows = _binned(rows, self.most_bytes).repartition("bin").sortWithinPartitions("bin", "at")
            publish(rows.select("value", "bin"), f"{self.path}/parts", f"roll={number}", ("bin",), text=True)
        parts = spark.read.schema("value string, bin bigint").text(f"{self.path}/parts/roll={number}")
        manifest = parts.groupBy("bin").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
        publish(manifest, f"{self.path}/manifest", f"roll={number}")
        for batch in range(after + 1, upto + 1):
            remove(spark, f"{self.path}/open/batch={batch}")
        return True

    def read(self, spark: SparkSession) -> DataFrame:
        """The lines of all files whose roll is done."""
        done = self._rolls(spark)
        if not done:
            return spark.createDataFrame([], "value string")
        rows = spark.read.schema("value string, roll int, bin bigint").text(f"{self.path}/parts")
        return rows.where(F.col("roll") < done).select("value")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """roll, bin, lines and bytes of each file."""
        rows = spark.read.schema("bin bigint, lines bigint, bytes bigint, roll int")
        return rows.parquet(make_folder(spark, f"{self.path}/manifest"))

    def _due(self, waiting) -> bool:
        now = self.clock()
        return (waiting["bytes"] >= self.most_bytes or now - waiting["oldest"] >= self.most_age
                or now - waiting["newest"] >= self.most_idle)

    def _upto(self, spark: SparkSession, number: int) -> int:
        """The last batch of a roll."""
        if number < 0:
            return -1
        return spark.read.schema("upto bigint").parquet(f"{self.path}/plans/number={number}").first()[0]

    def _rolls(self, spark: SparkSession) -> int:
        """How many rolls are done."""
        top = self.manifest(spark).agg(F.max("roll")).first()[0]
        return 0 if top is None else top + 1
