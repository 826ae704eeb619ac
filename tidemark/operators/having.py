"""The change log of ``SELECT key, sum(value) GROUP BY key HAVING sum(value) > bound``.

HAVING does not commute with weights, so its result needs a change log of its
own: when a group's sum moves, the old result row is taken back and the new one
is put in.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.running import running_sums
from tidemark.operators.zset import signed_sum


def having(rows: DataFrame, key: str, value: Column, bound: float, name: str = "sum_qty") -> DataFrame:
    """The groups of a plain table whose sum is above `bound`."""
    return rows.groupBy(key).agg(F.sum(value).alias(name)).where(F.col(name) > bound)


def transitions(sums: DataFrame, key: str, bound: float, name: str = "sum_qty") -> DataFrame:
    """Turn per-epoch sums ``(key, epoch, n, total)`` into a HAVING change log.

    A window holds one row per epoch that touched the key, however many rows
    the epochs had.
    """
    path = Window.partitionBy(key).orderBy("epoch")
    so_far = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.select(
        key, "epoch",
        F.sum("n").over(so_far).alias("n"),
        F.sum(name).over(so_far).alias("now"),
    )
    steps = running.withColumn("now", _shown("n", "now", bound)).withColumn("before", F.lag("now").over(path))
    return _replace(steps, [key, "epoch"], name)


def _shown(n: str, total: str, bound: float) -> Column:
    """The total if the group is in the result, else NULL."""
    return F.when((F.col(n) > 0) & (F.col(total) > bound), F.col(total))


def _replace(steps: DataFrame, keep: list[str], name: str) -> DataFrame:
    """From ``before`` and ``now`` results to a -1 row and a +1 row where they differ."""
    change = F.array(
        F.struct(F.lit(-1).alias("w"), F.col("before").alias(name)),
        F.struct(F.lit(1).alias("w"), F.col("now").alias(name)),
    )
    changed = steps.where(~F.col("now").eqNullSafe(F.col("before")))
    return changed.select(*keep, F.inline(change)).where(F.col(name).isNotNull())


def having_changelog(log: DataFrame, key: str, value: Column, bound: float, name: str = "sum_qty") -> DataFrame:
    """The HAVING change log ``(key, epoch, w, sum)`` of a whole change log.

    The sums per key and epoch are shuffled once more for the running totals;
    going by key alone from the start would save that, but would send every row
    of a heavy key to one task uncombined.
    """
    sums = signed_sum(log, [key], {name: value}, by_epoch=True)
    return transitions(sums, key, bound, name)


def having_row_changes(log: DataFrame, key: str, order: list[str], value: Column, bound: float,
                       name: str = "sum_qty", blocks: int | None = None) -> DataFrame:
    """The HAVING change log with a step per input row, not per epoch.

    Rows of a key are taken in `order`; each gives no, one or two result rows.
    """
    rows = log.select(*dict.fromkeys([key, "epoch", "w", *order]), (value * F.col("w")).alias("change"))
    return row_changes(running_sums(rows, [key], order, row_sums(F.col("change")), blocks), key, bound, name)


def row_sums(change: Column) -> dict[str, Column]:
    """What `row_changes` needs summed along a key, given a row's weighted value."""
    return {"now": change, "n": F.col("w"), "values": change.isNotNull().cast("int")}


def row_changes(rows: DataFrame, key: str, bound: float, name: str = "sum_qty") -> DataFrame:
    """The steps of rows that have ``w``, ``change`` and the running `row_sums`."""
    # A NULL value moves no sum; the sum of no values is NULL.
    had_values = F.col("values") > F.col("change").isNotNull().cast("int")
    earlier = rows.withColumns({
        "total_before": F.when(had_values, F.col("now") - F.coalesce("change", F.lit(0))),
        "n_before": F.col("n") - F.col("w"),
    })
    steps = earlier.withColumn("before", _shown("n_before", "total_before", bound))
    return _replace(steps.withColumn("now", _shown("n", "now", bound)), [key, "epoch"], name)
