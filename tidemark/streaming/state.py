"""Running totals of a stream, kept as parquet tables.

There is one small table of sums per batch, and now and then a compacted one of
everything so far.  All are parted by a hash of the key, and a batch reads only
the buckets of the keys it touches.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.zset import signed_sum
from tidemark.session import exists


@dataclass(frozen=True)
class Totals:
    """Net row count ``n`` and weighted sums per key, batch by batch.

    `keys` are compared with NULL equal to NULL.
    """

    path: str
    keys: list[str]
    sums: dict[str, Column]
    compact_every: int = 16
    # Fixed for the life of the tables.
    buckets: int = 64

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """Write down a batch's sums per key and epoch, and give them back.

        Running a batch again writes the same sums in the same place.
        """
        sums = signed_sum(batch, self.keys, self.sums, by_epoch=True)
        self._write(sums, self._batch_path(number))
        return batch.sparkSession.read.parquet(self._batch_path(number)).drop("bucket")

    def before(self, sums: DataFrame, number: int) -> DataFrame:
        """Totals before batch `number` of the keys in its `sums`, at epoch -1.

        The buckets they lie in, at most `buckets` numbers, say which folders to
        read.  Spark broadcasts the keys if they are few, by its own size check;
        the state is then filtered where it is read.
        """
        own = [row["bucket"] for row in sums.select(self._bucket()).distinct().collect()]
        state = self._state(sums.sparkSession, number, sums, own)
        touched = sums.select(*[F.col(key).alias(f"_{key}") for key in self.keys])
        same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in self.keys]
        totals = self._total(state.join(touched, same, "left_semi"))
        return totals.withColumn("epoch", F.lit(-1)).select(*sums.columns)

    def compact(self, spark: SparkSession, number: int) -> None:
        """After every `compact_every`-th batch, add everything up into one table."""
        done = self._base_path(number)
        if (number + 1) % self.compact_every or exists(spark, f"{done}/_SUCCESS"):
            return
        total = self.totals(spark, number)
        moved = F.col("n") != 0
        for name in self.sums:
            moved = moved | (F.col(name) != 0)
        self._write(total.where(moved), done)

    def totals(self, spark: SparkSession, number: int) -> DataFrame:
        """The totals of all keys after batch `number`."""
        like = spark.read.parquet(self._batch_path(number)).drop("bucket")
        return self._total(self._state(spark, number, like).unionByName(like.drop("epoch")))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, sums: DataFrame, path: str) -> None:
        rows = sums.select("*", self._bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _batch_path(self, number: int) -> str:
        return f"{self.path}/sums/batch={number}"

    def _base_path(self, number: int) -> str:
        return f"{self.path}/base/upto={number}"

    def _state(self, spark: SparkSession, number: int, like: DataFrame, only: list[int] | None = None) -> DataFrame:
        """Sums of all batches before `number`, maybe of some buckets: the last compacted table and what followed."""
        based = number // self.compact_every * self.compact_every
        columns = [c for c in like.columns if c != "epoch"]
        paths = [self._base_path(based - 1)] if based else []
        paths += [self._batch_path(i) for i in range(based, number)]
        if not paths:
            return like.select(*columns).limit(0)
        schema = StructType([*like.select(*columns).schema, StructField("bucket", IntegerType())])
        # Each path is a table of its own, with its buckets below it.
        tables = [spark.read.schema(schema).parquet(path) for path in paths]
        state = tables[0]
        for table in tables[1:]:
            state = state.unionByName(table)
        return (state if only is None else state.where(F.col("bucket").isin(only))).drop("bucket")

    def _total(self, sums: DataFrame) -> DataFrame:
        # Back to the types of one batch's sums, so that a total keeps its type
        # however often it is added up.
        types = dict(sums.dtypes)
        added = [F.sum(c).cast(types[c]).alias(c) for c in ("n", *self.sums)]
        return sums.groupBy(*self.keys).agg(*added)
