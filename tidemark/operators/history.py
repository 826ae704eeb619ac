"""The times in which the rows of a change log exist, as intervals of epochs.

An interval row ``(w, valid_from, valid_until, ...)`` says that a row has the net weight
`w` from epoch `valid_from` on and up to, not in, `valid_until`; NULL is "still".
"""

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.zset import net_changes
from tidemark.schemas import identity_columns

FROM, UNTIL = "valid_from", "valid_until"


def free_names(columns: list[str]) -> None:
    """Raise ValueError if a row's own columns are named like an interval's."""
    if clash := {FROM, UNTIL} & {c.lower() for c in columns}:
        raise ValueError(f"columns named like an interval's: {sorted(clash)}")


def intervals(log: DataFrame) -> DataFrame:
    """The intervals of a log's rows; together they hold each row once per change of its weight.

    Weights may be zero or, where a row is deleted before it comes, negative: such a row
    does not exist then.  NULLs are equal to each other; an empty log has no intervals.
    A window holds one row per epoch that touched a row, however many copies it has.
    """
    identity = identity_columns(log)
    free_names(identity)
    along = Window.partitionBy(*identity).orderBy("epoch")
    weight = F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return net_changes(log, by_epoch=True).select(
        weight.alias("w"), F.col("epoch").alias(FROM), F.lead("epoch").over(along).alias(UNTIL), *identity
    )


def as_of(spans: DataFrame, epoch: int) -> DataFrame:
    """The rows that exist at the end of `epoch`, as `zset.snapshot` gives them."""
    began, still = F.col(FROM) <= epoch, F.col(UNTIL).isNull() | (F.col(UNTIL) > epoch)
    return spans.where(began & still & (F.col("w") > 0)).drop(FROM, UNTIL)
