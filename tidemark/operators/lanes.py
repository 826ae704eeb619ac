"""Spreading the keys of a streaming join over several tasks.

Batch joins leave skew to adaptive execution, which streaming joins do not
have, and which keys will be heavy is not known when a query starts.  So the
rows of the many side are dealt out to lanes whatever their key, and the one
side's rows, which are far fewer, are repeated in each lane.
"""

from pyspark.sql import DataFrame, functions as F

# Fixed for the life of a query's checkpoint, like its state partitions.
LANES = 8


def deal(many: DataFrame, lanes: int = LANES) -> DataFrame:
    """Add ``many_lane`` to the many side, by its rows' content."""
    # A `place` in the source tells even equal rows apart.
    told_by = ["place"] if "place" in many.columns else many.columns
    return many.withColumn("many_lane", F.pmod(F.xxhash64(*told_by), F.lit(lanes)).cast("int")).drop("place")


def repeat(one: DataFrame, lanes: int = LANES) -> DataFrame:
    """The one side once in every ``lane``."""
    return one.drop("place").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
