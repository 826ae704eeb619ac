"""Semi- and anti-joins of change logs, by counts of support.

A key's support is the number of rows of the right log that have it.  The result
changes only where support leaves or reaches zero: a second row of a key that has one,
or a row replaced by another of its key within an epoch, moves nothing.

Logs are valid ones (`zset.valid`): no row goes before it came.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.zset import net_changes, signed_sum, weighted_join
from tidemark.schemas import identity_columns


def crossing(support: str, change: str) -> Column:
    """1 where a support begins to be above zero, -1 where it ends, else 0."""
    now, before = F.col(support) > 0, (F.col(support) - F.col(change)) > 0
    return now.cast("int") - before.cast("int")


def presence(log: DataFrame, keys: list[str]) -> DataFrame:
    """The change log ``(w, epoch, *keys)`` of the keys that a log's rows have.

    Rows are counted per key and epoch before the shuffle; a window holds one row per
    epoch that touched a key.  A NULL key is a key like any other here.
    """
    along = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = signed_sum(log, keys, {}, by_epoch=True).withColumn("support", F.sum("n").over(along))
    return counts.select(crossing("support", "n").alias("w"), "epoch", *keys).where("w <> 0")


def semi_join_changes(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """The change log of the left rows whose key some right row has, netted per epoch.

    A NULL key has no match.  The left log's columns come back as they are, whatever
    the right log's are named.
    """
    own, other = on
    key = "_key"
    while key in left.columns:
        key += "_"
    keys = presence(right.select("w", "epoch", F.col(other).alias(key)), [key])
    return net_changes(weighted_join(left, keys, [(own, key)]).select(*left.columns), by_epoch=True)


def anti_join_changes(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """The change log of the left rows whose key no right row has; rows with a NULL key are among them."""
    matched = semi_join_changes(left, right, on).withColumn("w", -F.col("w"))
    columns = ["w", "epoch", *identity_columns(left)]
    return net_changes(left.select(*columns).unionByName(matched.select(*columns)), by_epoch=True)
