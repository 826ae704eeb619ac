"""Fingerprints of change logs: a planted wrong row is found with its bucket, and nothing else."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.audit import audit, bucket_of, fingerprints, suspects

LOG = "w int, epoch int, k bigint, name string, other string"


def random_log(seed, many=60):
    rand = random.Random(seed)
    return [(rand.choice([1, 1, -1, 2]), rand.randrange(3), rand.choice([1, 2, 3, 4, 5, None]),
             rand.choice(["a", "", None]), rand.choice(["a", "", None])) for _ in range(many)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_logs_that_net_to_the_same_do_not_differ(spark):
    log = random_log(1)
    shuffled = random.Random(2).sample(log, len(log))
    # The same in other pieces: a weight of 2 as two rows, and a row that comes and goes.
    pieces = [(w // abs(w), *rest) for w, *rest in shuffled for _ in range(abs(w))] + [(5, 1, 9, "x", "y"), (-5, 1, 9, "x", "y")]
    a, b = spark.createDataFrame(log, LOG), spark.createDataFrame(pieces, LOG).repartition(5)
    assert audit(a, b, ["k"]).count() == suspects(a, b, ["k"]).count() == 0
    assert rows(fingerprints(a, ["k"]), "epoch", "bucket", "digest0") == rows(fingerprints(b, ["k"]), "epoch", "bucket", "digest0")


@pytest.mark.parametrize("wrong, right", [
    ((1, 1, 3, "a", "b"), (1, 1, 3, "b", "a")),
    ((1, 2, None, None, "a"), (1, 2, None, "a", None)),
    ((1, 0, 2, "", None), (1, 0, 2, None, "")),
    ((2, 0, 2, "a", "a"), (3, 0, 2, "a", "a")),
    ((1, 0, 4, "a", "a"), (1, 1, 4, "a", "a")),
])
def test_a_planted_row_is_found_with_its_bucket(spark, wrong, right):
    log = random_log(3)
    kept, wanted = spark.createDataFrame([*log, wrong], LOG), spark.createDataFrame([*log, right], LOG)
    home = spark.createDataFrame([wrong], LOG).select(bucket_of(["k"], 64)).first()[0]
    assert rows(audit(kept, wanted, ["k"], 64), "epoch", "bucket") == [(e, home) for e in sorted({wrong[1], right[1]})]
    net = {}
    for sign, (w, *rest) in ((1, wrong), (-1, right)):
        net[tuple(rest)] = net.get(tuple(rest), 0) + sign * w
    assert rows(suspects(kept, wanted, ["k"], 64), "epoch", "k", "name", "other", "w") == sorted(
        ((*row, w) for row, w in net.items() if w), key=repr)


def test_empty_logs_and_other_types(spark):
    empty, log = spark.createDataFrame([], LOG), spark.createDataFrame([(1, 0, 1, "a", "b")], LOG)
    assert audit(empty, empty, ["k"]).count() == 0
    assert [(r.kept_rows, r.wanted_rows) for r in audit(log, empty, ["k"]).collect()] == [(1, 0)]
    assert [(r.kept_rows, r.wanted_rows) for r in audit(empty, log, ["k"]).collect()] == [(0, 1)]
    with pytest.raises(ValueError):
        audit(log, log.withColumn("k", F.col("k").cast("int")), ["k"])


def test_logs_are_not_joined_with_each_other(spark):
    log = spark.createDataFrame(random_log(4), LOG)
    plan = audit(log, log, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_sum" in plan
