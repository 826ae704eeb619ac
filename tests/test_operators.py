import time
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from small import all_q18_changes, all_q18_results, c, l, logs, o
from tidemark.operators import running, zset
from tidemark.operators.having import having_changelog, having_row_changes
from tidemark.operators.lanes import deal, repeat
from tidemark.operators.maintain import delete_by_key, guard
from tidemark.operators.running import previous, running_sums
from tidemark.plans import joins, q3, q18
from tidemark.session import SMALL_TASKS, written
from tidemark.sources.jdbc import Database, Split


def pairs(df):
    return sorted((r.o_orderkey, int(r.sum_qty)) for r in df.collect())


def test_q18_at_every_epoch(spark):
    """All cases side by side: batch SQL, rewrite, weighted join and change log agree."""
    customer, orders, lines = logs(spark, *all_q18_changes())
    last = 2
    by_epoch = q18.by_epoch(customer, orders, lines, last).collect()
    for epoch in range(last + 1):
        rows = all_q18_results(epoch)
        assert sorted((r.o_orderkey, int(r.sum_qty)) for r in by_epoch if r.epoch == epoch) == rows
        at = [zset.as_rows(zset.snapshot(log, epoch)) for log in (customer, orders, lines)]
        assert pairs(q18.batch(*at)) == rows
        assert pairs(q18.rewritten(*at)) == rows
        joined = joins.customer_orders_lines(customer, orders, lines).where(F.col("epoch") <= epoch)
        assert pairs(q18.result(joined)) == rows


def test_no_negative_pairs(spark):
    for changes in ([c(1, 0, 1), o(1, 0, 1), o(-1, 1, 1), c(-1, 1, 1)], [c(1, 0, 1), c(-1, 1, 1), o(1, 2, 1)]):
        customer, orders, _ = logs(spark, *changes)
        assert zset.net_changes(joins.customer_orders(customer, orders)).count() == 0


def test_orphans_are_reported_and_do_no_harm(spark):
    customer, orders, _ = logs(spark, c(1, 0, 1), o(1, 0, 1), o(-1, 1, 2))
    assert [(r.o_orderkey, r.w) for r in zset.orphans(orders).collect()] == [(2, -1)]
    live = joins.customer_orders(zset.snapshot(customer), zset.snapshot(orders))
    assert [r.o_orderkey for r in live.collect()] == [1]


def test_copies_are_kept(spark):
    _, _, lines = logs(spark, *[l(1, 0, 1)] * 7, l(-1, 1, 1))
    snap = zset.snapshot(lines)
    assert [r.w for r in snap.collect()] == [6]
    for per_task in (1, 4, 100):
        assert zset.as_rows(snap, per_task).count() == 6


def test_change_counts(spark):
    _, orders, _ = logs(spark, o(1, 0, 1), o(1, 0, 2), o(-1, 1, 1), o(1, 0, 3, customer=2))
    found = sorted(tuple(r) for r in zset.change_counts(orders, "o_custkey").collect())
    assert found == [(1, 2, 1, 1), (2, 1, 0, 1)]


def test_delete_by_key_takes_all_rows_of_the_key(spark):
    _, _, lines = logs(spark, l(1, 0, 1, 5), l(1, 0, 1, 6), l(-1, 1, 1, 5), l(1, 2, 1, 7), l(1, 0, 2, 8))
    left = delete_by_key(lines, ["l_orderkey", "l_partkey"], ["epoch"])
    assert sorted(int(r.l_quantity) for r in left.collect()) == [7, 8]
    assert sorted(int(r.l_quantity) for r in zset.snapshot(lines).collect()) == [6, 7, 8]


@pytest.mark.parametrize("blocks", [1, 4])
@pytest.mark.parametrize("signs, accepted", [
    ([1, 1, -1, -1, 1], [0, 2, 4]), ([-1, 1, -1], [1, 2]), ([-1, -1], []), ([1, -1, 1, -1], [0, 1, 2, 3])])
def test_guard(spark, signs, accepted, blocks):
    rows = [(w, i // 2, i, key) for key in (1, 2, None) for i, w in enumerate(signs)]
    log = spark.createDataFrame(rows, "w int, epoch int, seq int, c_custkey bigint")
    kept = guard(log.orderBy(F.desc("seq")), ["c_custkey"], ["epoch", "seq"], blocks)
    assert kept.columns == log.columns
    assert {(r.c_custkey, r.seq) for r in kept.collect()} == {(k, e) for k in (1, 2, None) for e in accepted}


def test_guard_wants_an_order_within_the_epoch(spark):
    log = spark.createDataFrame([], "w int, epoch int, c_custkey bigint")
    with pytest.raises(ValueError, match="seq"):
        guard(log, ["c_custkey"], ["epoch"])


def test_heavy_keys_run_in_blocks(spark):
    """Two keys, one of them NULL, with a third of all rows each give what one window gives."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 40).alias("k"),
        F.xxhash64("id").alias("at"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 11).cast("decimal(15,2)")).alias("v"),
    )
    window = Window.partitionBy("k").orderBy("at")
    want = rows.withColumns({
        "total": F.sum("v").over(window), "n": F.sum(F.lit(1)).over(window), "before": F.lag("v").over(window)})
    for blocks in (1, 30, None):
        sums = running_sums(rows, ["k"], ["at"], {"total": F.col("v"), "n": F.lit(1)}, blocks)
        got = previous(sums, ["k"], ["at"], "v", "before", blocks)
        assert got.dtypes[:3] == want.dtypes[:3] and got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ties_are_ordered_by_content(spark):
    """Whatever way rows come in and however they are cut, tied rows get the same sums."""
    rows = [(1, 0, v) for v in (3, 1, 2, 1, None, 5)]
    found = set()
    for part in (rows, rows[::-1], rows[3:] + rows[:3]):
        for blocks in (1, 5):
            df = spark.createDataFrame(part, "k int, at int, v int")
            out = running_sums(df, ["k"], ["at"], {"total": F.col("v")}, blocks)
            found.add(str(sorted(map(str, out.collect()))))
    assert len(found) == 1


def test_a_null_value_moves_no_result(spark):
    rows = [(1, 0, 7, None), (1, 1, 7, 350), (1, 2, 7, None), (1, 3, 7, 10), (1, 0, 8, None)]
    log = spark.createDataFrame(rows, "w int, epoch int, l_orderkey bigint, l_quantity int")
    for bound in (300, -1):
        got = having_row_changes(log, "l_orderkey", ["epoch"], F.col("l_quantity"), bound)
        assert sorted((r.epoch, r.w, r.sum_qty) for r in got.collect()) == [(1, 1, 350), (3, -1, 350), (3, 1, 360)]


def test_where_a_row_stood_is_no_part_of_it(spark):
    log = spark.createDataFrame([(1, 0, 5, 1), (-1, 1, 5, 2), (1, 0, 6, 3)], "w int, epoch int, c_custkey bigint, place bigint")
    assert [r.c_custkey for r in zset.snapshot(log).collect()] == [6]
    own = spark.createDataFrame([(1, 0, "a"), (-1, 1, "b")], "w int, epoch int, tag string")
    assert [r.tag for r in zset.snapshot(own).collect()] == ["a"]


def test_orphan_deletes_make_no_rows(spark):
    """A customer and an order deleted without an insert: their weights must not multiply to a pair."""
    customer, orders, lines = logs(spark, c(-1, 0, 1), o(-1, 0, 1), l(1, 0, 1, 301), c(1, 0, 2), o(1, 1, 2, 2), l(1, 1, 2, 400),
                                   l(-1, 0, 2, 150, 9))
    by_epoch = q18.by_epoch(customer, orders, lines, 1).collect()
    assert [(r.epoch, r.o_orderkey, int(r.sum_qty)) for r in by_epoch] == [(1, 2, 400)]
    at = [zset.as_rows(zset.snapshot(log)) for log in (customer, orders, lines)]
    assert pairs(q18.batch(*at)) == [(2, 400)]
    assert [(r.o_orderkey, float(r.revenue)) for r in q3.batch(customer, orders, lines).collect()] == [(2, 90.0)]
    assert zset.net_changes(q18.changes(customer, orders, lines)).count() == 1


def test_rows_live_between_their_changes(spark):
    rows = [(1, 0, "a"), (-1, 2, "a"), (1, 3, "a"), (1, 1, "b"), (-1, 1, "b"), (2, 1, "c"), (-1, 2, "c"), (1, 9, "d"), (-1, 0, "e"), (1, 1, "e")]
    log = spark.createDataFrame(rows, "w int, epoch int, x string")
    got = sorted((r.epoch, r.x, r.w) for r in zset.at_epochs(log, 3).collect())
    assert got == [(0, "a", 1), (1, "a", 1), (1, "c", 2), (2, "c", 1), (3, "a", 1), (3, "c", 1)]


def test_row_changes_telescope_to_epoch_changes(spark):
    _, _, lines = logs(spark, l(1, 0, 1, 200), l(1, 0, 1, 150, 2), l(-1, 1, 1, 150, 2), l(1, 2, 1, 102, 3), l(1, 2, 1, 1, 4))
    value = F.col("l_quantity")
    by_epoch = having_changelog(lines, "l_orderkey", value, 300)
    for blocks in (1, 5):
        by_row = having_row_changes(lines, "l_orderkey", ["epoch", "l_partkey"], value, 300, blocks=blocks)
        found = sorted((r.epoch, r.w, int(r.sum_qty)) for r in by_row.collect())
        assert found == [(0, 1, 350), (1, -1, 350), (2, -1, 302), (2, 1, 302), (2, 1, 303)]
        net = zset.net_changes(by_row, by_epoch=True)
        assert sorted((r.epoch, r.w, int(r.sum_qty)) for r in net.collect()) == sorted(
            (r.epoch, r.w, int(r.sum_qty)) for r in by_epoch.collect())


def test_revenue_takes_deletes_back_but_its_running_form_does_not(spark):
    customer, orders, lines = logs(spark, c(1, 0, 1), o(1, 0, 1), l(1, 0, 1), l(-1, 1, 1))
    joined = q3.joined(customer, orders, lines)
    assert q3.result(joined).isEmpty()
    assert [r.revenue for r in q3.result(joined.where("epoch = 0")).collect()] == [Decimal("90.0000")]
    running = q3.running(joined, ["epoch"]).orderBy("epoch")
    assert [float(r.revenue) for r in running.collect()] == [90, 90]


def test_lanes_change_nothing(spark):
    customer, orders, lines = logs(
        spark, *[c(1, 0, k) for k in (1, 2, 3)], c(-1, 1, 1), *[o(1, 0, k, 1 if k < 30 else 2) for k in range(40)],
        *[l(1, 0, k % 7, 10, k) for k in range(60)])
    plain = joins.customer_orders_lines(customer, orders, lines)
    spread = joins.customer_orders_lines(customer, orders, lines, lanes=4)
    assert plain.columns == spread.columns
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()
    assert deal(orders, 8).where("o_custkey = 1").select("many_lane").distinct().count() > 1
    assert repeat(customer, 8).where("c_custkey = 3").count() == 8


def test_database_options():
    db = Database("jdbc:x:y", {"user": "u"})
    assert db.query_options("SELECT 1") == {"url": "jdbc:x:y", "user": "u", "query": "SELECT 1"}
    split = db.query_options("SELECT a FROM t", Split("a", "0", "100", 4))
    assert split["dbtable"] == "(SELECT a FROM t) q" and split["numPartitions"] == "4" and "query" not in split


def test_rows_of_running_sums_are_written_by_small_tasks(spark, monkeypatch):
    """What feeds running sums is computed by tasks of bounded input; the session's settings come back."""
    def current():
        return {key: spark.conf.get(key) for key in SMALL_TASKS}

    seen, before = [], current()
    monkeypatch.setattr(running, "written", lambda df, name: seen.append(current()) or written(df, name))
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 1, 1)], "k int, at int, v int")
    got = running_sums(rows, ["k"], ["at"], {"total": F.col("v")})
    assert sorted((r.k, r.at, r.total) for r in got.collect()) == [(1, 1, 5), (1, 2, 12), (2, 1, 1)]
    assert seen == [SMALL_TASKS] != [before] and current() == before


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.startswith("shuffle_")}

    def dealt():
        return spark.range(1000).repartition(3, "id")

    before = files()
    dealt().write.format("noop").mode("overwrite").save()
    assert files() - before
    before = files()
    table = written(dealt(), "dealt")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert table.count() == 1000
