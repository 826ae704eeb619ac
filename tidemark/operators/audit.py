"""Comparing two change logs, a kept result with the batch query say, without joining or netting them.

Each log becomes a fingerprint per epoch and bucket of keys: the weighted sum of its
rows' hashes.  Sums do not depend on order, files or batches, and a row that comes and
goes within an epoch adds nothing; so logs that net to the same have the same sums.
Hashes are added up before the shuffle, and what is compared has a row per epoch and
bucket.  Only the buckets that differ are then looked at row by row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.zset import net_changes
from tidemark.schemas import identity_columns

BUCKETS = 1024
#: Seeds of the two hashes of a row.
SEEDS = (11, 23)


def bucket_of(keys: list[str], buckets: int) -> Column:
    """A bucket of keys; NULL is a key like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _digest(columns: list[str], seed: int) -> Column:
    # A hash passes over NULLs: their places go in beside the values.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    # Decimals, as sums of 64-bit numbers would overflow.
    return F.xxhash64(F.lit(seed), nulls, *columns).cast("decimal(20,0)")


def _summed(log: DataFrame, keys: list[str], columns: list[str], buckets: int) -> DataFrame:
    weight = F.col("w").cast("decimal(10,0)")
    sums = [F.sum(weight * _digest(columns, seed)).alias(f"digest{n}") for n, seed in enumerate(SEEDS)]
    return log.groupBy("epoch", bucket_of(keys, buckets).alias("bucket")).agg(F.sum("w").alias("rows"), *sums)


def fingerprints(log: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(epoch, bucket, rows, digest0, digest1)`` of a log; groups whose changes cancel are left out."""
    summed = _summed(log, keys, sorted(identity_columns(log)), buckets)
    return summed.where((F.col("rows") != 0) | (F.col("digest0") != 0) | (F.col("digest1") != 0))


def _same_columns(kept: DataFrame, wanted: DataFrame) -> None:
    types = [{c: df.schema[c].dataType for c in identity_columns(df)} for df in (kept, wanted)]
    if types[0] != types[1]:
        raise ValueError(f"logs of different columns: {types[0]} and {types[1]}")


def audit(kept: DataFrame, wanted: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(epoch, bucket, kept_rows, wanted_rows)`` where two logs differ; none if they net to the same.

    The logs must have the same columns and types, else ValueError: equal values of two
    types have different hashes.  Two empty logs do not differ.
    """
    _same_columns(kept, wanted)
    one, other = fingerprints(kept, keys, buckets), fingerprints(wanted, keys, buckets)
    minus = other.select("epoch", "bucket", *[(-F.col(c)).alias(c) for c in ("rows", "digest0", "digest1")], F.col("rows").alias("wanted_rows"))
    both = one.withColumns({"kept_rows": F.col("rows"), "wanted_rows": F.lit(0)}).unionByName(minus.withColumn("kept_rows", F.lit(0)))
    sums = {c: F.sum(c).alias(c) for c in ("rows", "digest0", "digest1", "kept_rows", "wanted_rows")}
    differing = both.groupBy("epoch", "bucket").agg(*sums.values())
    differing = differing.where((F.col("rows") != 0) | (F.col("digest0") != 0) | (F.col("digest1") != 0))
    return differing.select("epoch", "bucket", "kept_rows", "wanted_rows")


def suspects(kept: DataFrame, wanted: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows by which two logs differ, per epoch: `w` is what the kept log has too much, or too little.

    Only rows of buckets that `audit` names are netted; Spark broadcasts the names if
    they are few, by its own size check.
    """
    found = audit(kept, wanted, keys, buckets).select(F.col("epoch").alias("_epoch"), F.col("bucket").alias("_bucket"))
    columns = ["w", "epoch", *identity_columns(kept)]
    both = kept.select(*columns).unionByName(wanted.select(*columns).withColumn("w", -F.col("w")))
    same = (F.col("epoch") == F.col("_epoch")) & (bucket_of(keys, buckets) == F.col("_bucket"))
    return net_changes(both.join(found, same, "left_semi"), by_epoch=True)
