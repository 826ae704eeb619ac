"""What streams and gates leave on disk."""

import glob
import time

from pyspark.sql import functions as F

from small import SCHEMAS, c, l, logs, o
from tidemark.plans import q3, q18
from tidemark.session import publish
from tidemark.sources.table_log import with_place
from tidemark.streaming.delta import both, payload
from tidemark.streaming.gate import EpochGate, marked
from tidemark.streaming.runner import finish


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {path for path in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in path}


def left(spark, before, seconds=10):
    """Shuffle files that are new and stay; they go some time after their query."""
    for _ in range(seconds * 10):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def started(spark, folder):
    for name, log in zip("col", logs(spark, c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 5))):
        log.coalesce(1).write.parquet(f"{folder}/{name}")
    streams = [with_place(spark.readStream.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")) for name in "col"]
    query = q18.start_joined(*streams, f"{folder}/out", f"{folder}/checkpoint", available_now=True, state_partitions=2)
    finish(query)
    return query


def test_what_is_shuffled_for_a_write_goes_with_it(spark, folder):
    before = shuffle_files(spark)
    publish(spark.range(1000).groupBy(F.col("id") % 7).count(), folder, "counts")
    assert not left(spark, before)


def test_what_a_stream_shuffles_goes_with_its_batch(spark, folder):
    before = shuffle_files(spark)
    started(spark, folder)
    assert not left(spark, before)


def test_the_state_of_a_joined_stream_has_each_order_once(spark, folder):
    query = started(spark, folder)
    # A line and its order; eight lanes of a customer and an order.
    assert sorted(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == [2, 9]


def test_the_checkpoint_has_the_state_once(spark, folder):
    started(spark, folder)
    assert glob.glob(f"{folder}/checkpoint/state/**/*.zip", recursive=True)
    assert not glob.glob(f"{folder}/checkpoint/state/**/*.changelog", recursive=True)


def test_a_released_epoch_is_kept_in_the_history_alone(spark, folder):
    tables = dict(zip("col", logs(spark, c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 301), l(-1, 1, 1, 301))))
    gate = EpochGate(folder, {name: payload(log) for name, log in tables.items()})

    def result(tables, last):
        return q18.by_epoch(tables["c"], tables["o"], tables["l"], last=last)

    for epoch in range(2):
        for name, log in tables.items():
            gate.take(name)(marked(log.where(F.col("epoch") == epoch), epoch), epoch)
        if epoch == 0:
            assert glob.glob(f"{folder}/rows/l/batch=0/epoch=0")
        assert gate.release(spark, result) == epoch
        assert not glob.glob(f"{folder}/rows/*/batch=*/epoch=*")
    assert [(r.epoch, r.o_orderkey) for r in gate.read(spark).collect()] == [(0, 1)]
    assert gate.as_of(spark, "l", 0).count() == 1 and gate.as_of(spark, "l", 1).isEmpty()


def test_live_tuples_keep_no_moves_of_a_done_batch(spark, folder):
    changes = logs(spark, c(1, 0, 1), o(1, 0, 1), l(1, 0, 1))
    live = q3.live_tuples(*changes, folder)[0]
    customer, orders = changes[0].select("w", "epoch", *live.parent.names), changes[1].select("w", "epoch", *live.row.names)
    for _ in range(2):  # run again, as after a lost commit
        live.step(both(customer, orders), 0)
        assert not glob.glob(f"{folder}/orders/moves/batch=*") and not glob.glob(f"{folder}/orders/rows/batch=*")
        assert [r.o_orderkey for r in live.read(spark).collect()] == [1]
        assert [(r.n, r.parents) for r in live.table.read(spark, 0).collect()] == [(1, 1)]


def test_the_joined_sums_look_up_no_key_to_count_it(spark, folder):
    for name, log in zip("col", logs(spark, c(1, 0, 1), o(1, 0, 1), l(1, 0, 1))):
        log.coalesce(1).write.parquet(f"{folder}/{name}")
    customer, orders, lines = [with_place(spark.readStream.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")) for name in "col"]
    finish(q3.start_sums(lines, f"{folder}/sums", f"{folder}/c0", available_now=True, state_partitions=2))
    query = q3.start_joined(customer, orders, q3.stream_sums(spark, f"{folder}/sums"), f"{folder}/out", f"{folder}/c1",
                            available_now=True, state_partitions=2, lanes=None)
    finish(query)
    # Two rows and their one pair; each put looked up its key before.
    assert [op["customMetrics"]["rocksdbGetCount"] for op in query.lastProgress["stateOperators"]] == [5, 5]
    assert q3.read_joined(spark, f"{folder}/out").count() == 1
