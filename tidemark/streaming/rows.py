"""Operators that follow a log row by row, over batches: guard, running sums, delete by key.

Each keeps a table with one row per key of what the rows so far left behind.  A batch
puts these in front of its own rows, so that a key may go on over any number of
batches, and a heavy key be cut into blocks within one.

Batches come in the log's order: no row of a batch is before one of an earlier batch
in `order`.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.operators.maintain import accepted, delete_by_key, tells_apart
from tidemark.operators.running import Names, previous, running_sums, same_keys
from tidemark.session import exists, publish
from tidemark.streaming.kept import KeptTable


def _of_keys(rows: DataFrame, keys: list[str], other: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key is, or is not, one of the other's."""
    own = Names(rows)
    return rows.join(other.select(*[F.col(c).alias(own(c)) for c in keys]).distinct(), same_keys(keys, own), how)


@dataclass(frozen=True)
class GuardedKeys:
    """`maintain.guard` over a stream: only the changes that change something.

    Use `step` as a foreachBatch function; what passes goes to ``path/log/batch=i``.
    The sign of each key's last change is kept in `table`.
    """

    path: str
    keys: list[str]
    order: list[str]
    blocks: int | None = None

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def table(self, schema: StructType) -> KeptTable:
        return KeptTable(f"{self.path}/signs", self.keys, StructType([schema[k] for k in self.keys]).add("w", IntegerType()))

    def step(self, batch: DataFrame, number: int) -> None:
        tells_apart(self.order)
        spark, table = batch.sparkSession, self.table(batch.schema)
        touched = table.touched(batch)
        signs = table.read(spark, number - 1, touched)
        if not exists(spark, f"{self.log_path}/batch={number}"):
            own = Names(batch)
            first, before = own("first"), own("before")
            earlier = _of_keys(signs, self.keys, batch).withColumn(first, F.lit(0))
            rows = batch.withColumn(first, F.lit(1)).unionByName(earlier, allowMissingColumns=True)
            seen = previous(rows, self.keys, [first, *self.order], "w", before, self.blocks)
            publish(seen.where((F.col(first) == 1) & accepted(before)).select(*batch.columns), self.log_path, f"batch={number}")
        last = batch.groupBy(*self.keys).agg(F.max_by("w", F.struct(*self.order)).cast("int").alias("w"))
        table.write(_of_keys(signs, self.keys, last, "left_anti").unionByName(last), touched, number)


@dataclass(frozen=True)
class RunningLog:
    """`running_sums` over a stream: each row with the sums of its key so far.

    Use `step` as a foreachBatch function; the rows go to ``path/log/batch=i``.  The
    keys' totals are kept: a batch's first block of a key goes on from them.
    """

    path: str
    keys: list[str]
    order: list[str]
    sums: dict[str, Column]
    blocks: int | None = None

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def step(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        added = batch.groupBy(*self.keys).agg(*[F.sum(c).alias(n) for n, c in self.sums.items()])
        table = KeptTable(f"{self.path}/totals", self.keys, added.schema)
        types = {n: added.schema[n].dataType for n in self.sums}
        touched = table.touched(batch)
        totals = table.read(spark, number - 1, touched)
        if not exists(spark, f"{self.log_path}/batch={number}"):
            own = Names(batch)
            first, values = own("first"), {n: own(f"value_{n}") for n in self.sums}
            earlier = _of_keys(totals, self.keys, batch).withColumnsRenamed(values).withColumn(first, F.lit(0))
            rows = batch.withColumns({first: F.lit(1), **{values[n]: c.cast(types[n]) for n, c in self.sums.items()}})
            rows = rows.unionByName(earlier, allowMissingColumns=True)
            running = running_sums(rows, self.keys, [first, *self.order], {n: F.col(v) for n, v in values.items()}, self.blocks)
            kept = [c for c in batch.columns if c not in self.sums]
            running = running.where(F.col(first) == 1).select(*kept, *[F.col(n).cast(types[n]).alias(n) for n in self.sums])
            publish(running, self.log_path, f"batch={number}")
        now = totals.unionByName(added).groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.sums])
        table.write(now, touched, number)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.log_path).drop("batch")


@dataclass(frozen=True)
class DeletedByKey:
    """`maintain.delete_by_key` on a kept table: a delete takes every row that has its key.

    Use `step` as a foreachBatch function; `read` gives the table.  A batch rewrites the
    buckets of the keys it changes.  Deletes at the highest place in `order` are kept
    too: they also take the inserts of that place that come with the next batch.
    """

    path: str
    keys: list[str]
    order: list[str]
    schema: StructType

    @property
    def table(self) -> KeptTable:
        return KeptTable(f"{self.path}/table", self.keys, self.schema)

    def step(self, batch: DataFrame, number: int) -> None:
        spark, names = batch.sparkSession, self.schema.names
        columns = [*self.keys, *self.order]
        late = KeptTable(f"{self.path}/deletes", self.keys, StructType([batch.schema[c] for c in columns]))
        touched = self.table.touched(batch)
        deletes = batch.where(F.col("w") < 0).select(*columns).distinct()
        earlier = late.read(spark, number - 1, touched)
        log = batch.unionByName(earlier.withColumn("w", F.lit(-1)), allowMissingColumns=True)
        inserted = delete_by_key(log.select("w", *dict.fromkeys([*self.order, *names])), self.keys, self.order)
        old = self.table.read(spark, number - 1, touched)
        # A NULL in a key is equal to nothing, as in the batch form.
        own = Names(old)
        gone = deletes.select(*[F.col(c).alias(own(c)) for c in self.keys]).distinct()
        rest = old.join(gone, [F.col(c) == F.col(own(c)) for c in self.keys], "left_anti")
        self.table.write(rest.unionByName(inserted.select(*names)), touched, number)
        top = batch.agg(F.max(F.struct(*[F.col(c).alias(own(c)) for c in self.order])).alias("top")).select("top.*")
        latest = deletes.unionByName(earlier).distinct().join(top, same_keys(self.order, own), "left_semi")
        late.write(latest, touched, number)

    def read(self, spark: SparkSession, number: int) -> DataFrame:
        return self.table.read(spark, number)
