"""Queries that feed a running stream: it takes each step's rows together, however slowly their files come."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

import __spark_entry__ as entry
from small import c, l, logs, o

# A task's files are in their folder as soon as it ends.
EARLY = "mapreduce.fileoutputcommitter.algorithm.version"


@F.udf(BooleanType())
def slowly(epoch):
    if epoch:
        time.sleep(3)
    return True


@pytest.fixture
def early_files(spark):
    spark.conf.set(EARLY, "2")
    yield
    spark.conf.unset(EARLY)


def late(log):
    """Its rows after epoch 0 are written some seconds after what is not its own."""
    return log.where(slowly(F.col("epoch")))


def test_no_mark_is_taken_before_the_rows_of_its_epoch(spark, monkeypatch, early_files):
    tables = logs(spark, c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 301), c(1, 1, 2), o(1, 1, 2, 2), l(1, 1, 2, 302))
    monkeypatch.setattr(entry, "_logs", lambda spark, sf_dir: [late(log) for log in tables])
    found = entry.queries()["q18_complete_epochs"](spark, "").collect()
    assert sorted((r.epoch, r.o_orderkey, r.sum_qty) for r in found) == [
        (0, 1, 301), (1, 1, 301), (1, 2, 302), (2, 1, 301), (2, 2, 302)]


def test_a_step_is_one_batch(spark, folder, early_files):
    log = spark.createDataFrame([(0, "first"), (1, "soon")], "epoch int, name string")
    log = log.coalesce(1).unionByName(late(spark.createDataFrame([(1, "late")], log.schema)))
    taken = []
    entry._play_steps(spark, log, "epoch", 1, folder, lambda batch, number: taken.append(sorted(r.name for r in batch.collect())))
    assert [names for names in taken if names] == [["first"], ["late", "soon"]]
