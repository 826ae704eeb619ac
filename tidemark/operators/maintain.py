"""Applying changes to a table: guards against bad changes, delete by key."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.running import Names, previous
from tidemark.schemas import CHANGE_COLUMNS


def guard(log: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Only the changes that change something.

    An insert counts if the key is absent, a delete if it is present.  Whatever
    was accepted, a key is present after an insert and absent after a delete,
    so the sign of the change before tells which is the case.  `order` must tell
    a key's changes apart: an epoch may hold several, so it is not enough.
    """
    tells_apart(order)
    before = Names(log)("before")
    seen = previous(log, keys, order, "w", before, blocks)
    return seen.where(accepted(before)).drop(before)


def tells_apart(order: list[str]) -> None:
    if set(order) <= {"epoch"}:
        raise ValueError("guard needs an order within the epoch, such as seq")


def accepted(before: str) -> Column:
    """Whether a change counts, by the sign of the key's change before it (NULL: none)."""
    absent = F.coalesce(F.col(before), F.lit(-1)) < 0
    return ((F.col("w") > 0) & absent) | ((F.col("w") < 0) & ~absent)


def delete_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table left when a delete removes every row that has its key.

    An inserted row stays iff no delete of its key comes later in `order`.
    """
    place, own = F.struct(*order), Names(log)
    deletes = log.where(F.col("w") < 0).groupBy(*[F.col(k).alias(own(k)) for k in keys]).agg(F.max(place).alias(own("deleted")))
    inserts = log.where(F.col("w") > 0).withColumn(own("at"), place)
    left = inserts.join(deletes, [F.col(k) == F.col(own(k)) for k in keys], "left")
    left = left.where(F.col(own("deleted")).isNull() | (F.col(own("at")) > F.col(own("deleted"))))
    return left.select(*[c for c in log.columns if c not in CHANGE_COLUMNS])
