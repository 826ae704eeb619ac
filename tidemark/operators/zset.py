"""Netting, snapshots, weighted joins and signed aggregates."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.schemas import identity_columns


def net_changes(log: DataFrame, by_epoch: bool = False) -> DataFrame:
    """One row per distinct row (and epoch), with its summed weight; zeros go.

    The sums are taken before the shuffle too, so a row with very many copies
    reaches its reducer as one partial sum per task.
    """
    keys = (["epoch"] if by_epoch else []) + identity_columns(log)
    summed = log.groupBy(*keys).agg(F.sum("w").alias("w"))
    return summed.where(F.col("w") != 0)


def snapshot(log: DataFrame, epoch: int | None = None) -> DataFrame:
    """The rows that exist once `epoch` (default: the whole log) is applied.

    A row inserted n times more than deleted comes with ``w = n``; a row deleted
    more often than inserted does not exist.
    """
    if epoch is not None:
        log = log.where(F.col("epoch") <= epoch)
    return net_changes(log).where(F.col("w") > 0)


def as_rows(snap: DataFrame, copies_per_task: int = 1_000_000) -> DataFrame:
    """A snapshot as a plain table: a row of weight n is there n times.

    A row with very many copies is dealt out to several tasks first.
    """
    part = F.lit(copies_per_task)
    few = snap.where(F.col("w") <= part)
    many = snap.where(F.col("w") > part)
    parts = many.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(w - 1) div {copies_per_task}"))).alias("at"))
    parts = parts.repartition(F.xxhash64("at", *identity_columns(snap)))
    parts = parts.withColumn("w", F.least(part, F.col("w") - F.col("at") * part)).drop("at")
    rows = few.unionByName(parts)
    return rows.select(*identity_columns(snap), F.explode(F.sequence(F.lit(1), F.col("w"))).alias("at")).drop("at")


def floored(sums: DataFrame, identity: list[str]) -> DataFrame:
    """From net counts per row and epoch to changes that never go below zero.

    A window holds one row per epoch that touched a row, however many copies it has.
    """
    along = Window.partitionBy(*identity).orderBy("epoch")
    count = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    live = sums.withColumn("live", F.greatest(count, F.lit(0)))
    change = F.col("live") - F.lag("live", 1, 0).over(along)
    return live.withColumn("w", change).where(F.col("w") != 0).select("w", "epoch", *identity)


def valid(log: DataFrame) -> DataFrame:
    """The log netted per epoch, with every row's weight held at zero or above.

    What joins and sums of change logs need: a row deleted without having been
    inserted would give negative weights, and two of them a positive pair.
    """
    return floored(net_changes(log, by_epoch=True).withColumnRenamed("w", "n"), identity_columns(log))


def orphans(log: DataFrame) -> DataFrame:
    """Rows deleted more often than inserted, with their negative weight."""
    return net_changes(log).where(F.col("w") < 0)


def change_counts(log: DataFrame, *keys: str) -> DataFrame:
    """Inserts, deletes and what is left, per key."""
    return log.groupBy(*keys).agg(
        F.count_if(F.col("w") > 0).alias("inserts"),
        F.count_if(F.col("w") < 0).alias("deletes"),
        F.sum("w").alias("live"),
    )


def weighted_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Inner equi-join of two logs or snapshots.

    The weight of a pair is the product of the weights, its epoch the later of
    the two.  As the join is linear in both inputs, joining `valid` change logs
    and netting afterwards gives the join of the netted tables.  Works on streams.
    """
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("w", "epoch") if c in right.columns})
    pairs = left.join(right, [F.col(a) == F.col(b) for a, b in on])
    change = {"w": F.col("w") * F.col("_w")}
    if "epoch" in left.columns and "_epoch" in right.columns:
        change["epoch"] = F.greatest("epoch", "_epoch")
    return pairs.withColumns(change).drop("_w", "_epoch")


def signed_sum(log: DataFrame, keys: list[str], sums: dict[str, Column], by_epoch: bool = False) -> DataFrame:
    """Group a log and sum ``w * value`` per group; ``n`` is the net row count.

    With `by_epoch` the sums are those of each epoch's changes alone.
    """
    groups = keys + (["epoch"] if by_epoch else [])
    return log.groupBy(*groups).agg(
        F.sum("w").alias("n"),
        *[F.sum(value * F.col("w")).alias(name) for name, value in sums.items()],
    )


def existing(groups: DataFrame) -> DataFrame:
    """Groups of `signed_sum` that still hold rows; counted, not read off a sum."""
    return groups.where(F.col("n") > 0).drop("n")


def at_epochs(changes: DataFrame, last_epoch: int) -> DataFrame:
    """What exists at the end of each epoch from 0 to `last_epoch`.

    A row's changes become the times between them, with its weight then; only
    times in which it exists are repeated, epoch by epoch.
    """
    identity = identity_columns(changes)
    along = Window.partitionBy(*identity).orderBy("epoch")
    until = F.coalesce(F.lead("epoch").over(along), F.lit(last_epoch + 1)) - 1
    weight = F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    times = net_changes(changes, by_epoch=True).withColumns({"until": F.least(until, F.lit(last_epoch)), "now": weight})
    lasting = times.where("now > 0 AND epoch <= until")
    return lasting.select(F.explode(F.sequence("epoch", "until")).alias("epoch"), *identity, F.col("now").alias("w"))


def last_epoch(*logs: DataFrame) -> int:
    """The highest epoch in the logs (one value, from per-task maxima)."""
    tops = [log.agg(F.max("epoch").alias("epoch")) for log in logs]
    union = tops[0]
    for top in tops[1:]:
        union = union.unionByName(top)
    top = union.agg(F.max("epoch")).first()[0]
    return -1 if top is None else top
