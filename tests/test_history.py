"""Intervals, semi-joins by support and the epoch gate against snapshots, for any batch cut."""

import random

import pytest
from pyspark.sql import functions as F

from small import all_q18_changes, all_q18_results, logs
from tidemark.operators.history import as_of, intervals
from tidemark.operators.support import anti_join_changes, presence, semi_join_changes
from tidemark.operators.zset import net_changes, snapshot, valid
from tidemark.plans import q18
from tidemark.streaming.delta import payload
from tidemark.streaming.gate import EpochGate, marked
from tidemark.streaming.history import History
from tidemark.streaming.kept import KeptTable
from tidemark.streaming.support import SupportLog

LOG = "w int, epoch int, k bigint, name string"
EPOCHS = 4


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(KeptTable.__init__, "__defaults__", (3,))


def random_log(seed, many=12):
    """Rows that repeat, come back, have NULL keys, or are deleted before they come."""
    rand = random.Random(seed)
    return [(rand.choice([1, 1, -1]), epoch, rand.choice([1, 1, 1, 2, 3, None]), rand.choice(["a", "b", "", None]))
            for epoch in range(EPOCHS) for _ in range(many)]


def live(log, epoch):
    """Plain snapshot: net weight by row."""
    found = {}
    for w, e, *row in log:
        if e <= epoch:
            found[tuple(row)] = found.get(tuple(row), 0) + w
    return {row: w for row, w in found.items() if w > 0}


def cuts(log, seed):
    """The log in batches that cut epochs anywhere; rows within an epoch in any order."""
    rand = random.Random(seed)
    rand.shuffle(log)
    log = sorted(log, key=lambda r: r[1])
    at = sorted(rand.sample(range(1, len(log)), 3))
    return [log[a:b] for a, b in zip([0, *at], [*at, len(log)])]


@pytest.mark.parametrize("seed", [1, 2])
def test_history_gives_any_epoch(spark, folder, seed):
    log = random_log(seed)
    whole = spark.createDataFrame(log, LOG)
    kept = History(folder, payload(whole))
    batches = cuts(log, seed)
    for number, part in enumerate(batches):
        batch = spark.createDataFrame(part, LOG)
        kept.step(batch, number)
        kept.step(batch, number)
    spans = intervals(whole)
    for epoch in range(EPOCHS):
        want = sorted(((*row, w) for row, w in live(log, epoch).items()), key=repr)
        assert rows(kept.as_of(spark, len(batches) - 1, epoch), "k", "name", "w") == want
        assert rows(as_of(spans, epoch), "k", "name", "w") == want
        assert rows(snapshot(whole, epoch), "k", "name", "w") == want


def test_a_reader_of_an_older_batch_sees_its_state(spark, folder):
    first = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "a")], LOG)
    kept = History(folder, payload(first))
    kept.step(first, 0)
    kept.step(spark.createDataFrame([(-1, 1, 1, "a")], LOG), 1)
    assert rows(kept.as_of(spark, 0, 0), "k") == rows(kept.as_of(spark, 1, 0), "k") == [(1,), (2,)]
    assert rows(kept.as_of(spark, 1, 1), "k") == [(2,)]


def test_history_is_pruned_by_both_ends(spark, folder):
    first = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "a")], LOG)
    kept = History(folder, payload(first))
    kept.step(first, 0)
    for epoch in (1, 2):
        kept.step(spark.createDataFrame([(-1, epoch, epoch, "a")], LOG), epoch)
    plan = kept.as_of(spark, 2, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "(valid_until" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "LessThanOrEqual(valid_from,1)" in plan
    files = as_of(kept.closed(spark, 2), 1).inputFiles()
    assert rows(kept.as_of(spark, 2, 1), "k") == [(2,)]
    assert files and kept.table.read(spark, 2).count() == 0


def test_empty_logs_and_clashing_names(spark, folder):
    empty = spark.createDataFrame([], LOG)
    kept = History(folder, payload(empty))
    kept.step(empty, 0)
    assert kept.as_of(spark, 0, 0).count() == intervals(empty).count() == presence(empty, ["k"]).count() == 0
    assert semi_join_changes(empty, empty, ("k", "k")).count() == 0
    clash = empty.withColumn("valid_from", F.lit(1))
    with pytest.raises(ValueError):
        History(folder, payload(clash))
    with pytest.raises(ValueError):
        intervals(clash)


@pytest.mark.parametrize("seed", [3, 4])
def test_semi_and_anti_joins_at_every_epoch(spark, seed):
    left, right = random_log(seed), random_log(seed + 10, 5)
    a, b = [valid(spark.createDataFrame(log, LOG)) for log in (left, right)]
    semi, anti = semi_join_changes(a, b, ("k", "k")), anti_join_changes(a, b, ("k", "k"))
    assert semi.columns == anti.columns == ["epoch", "k", "name", "w"]
    for epoch in range(EPOCHS):
        keys = {r["k"] for r in snapshot(b, epoch).collect()} - {None}
        own = [(r["k"], r["name"], r["w"]) for r in snapshot(a, epoch).collect()]
        assert rows(snapshot(semi, epoch), "k", "name", "w") == sorted([r for r in own if r[0] in keys], key=repr)
        assert rows(snapshot(anti, epoch), "k", "name", "w") == sorted([r for r in own if r[0] not in keys], key=repr)


def test_support_moves_only_at_zero(spark):
    """A second row of a key, and one replaced within an epoch, move nothing."""
    right = spark.createDataFrame(
        [(1, 0, 1, "a"), (1, 1, 1, "b"), (-1, 1, 1, "a"), (1, 2, 1, "a"), (-1, 3, 1, "a"), (-1, 3, 1, "b")], LOG)
    assert rows(presence(right, ["k"]), "epoch", "k", "w") == [(0, 1, 1), (3, 1, -1)]
    left = spark.createDataFrame([(1, 0, 1, "x"), (2, 0, 1, "y"), (1, 0, None, "z")], LOG)
    assert rows(semi_join_changes(left, right, ("k", "k")), "epoch", "name", "w") == [
        (0, "x", 1), (0, "y", 2), (3, "x", -1), (3, "y", -2)]


@pytest.mark.parametrize("seed", [5, 6])
def test_support_over_a_stream(spark, folder, seed):
    log = [tuple(r) for r in valid(spark.createDataFrame(random_log(seed), LOG)).select("w", "epoch", "k", "name").collect()]
    whole = spark.createDataFrame(log, LOG)
    kept = SupportLog(folder, payload(whole.select("k")))
    batches = cuts(log, seed)
    for number, part in enumerate(batches):
        batch = spark.createDataFrame(part, LOG)
        kept.step(batch, number)
        kept.step(batch, number)
    got = spark.read.parquet(kept.log_path).drop("batch")
    for epoch in range(EPOCHS):
        assert rows(snapshot(got, epoch), "k", "w") == rows(snapshot(presence(whole, ["k"]), epoch), "k", "w")
    support = {}
    for (k, _), w in live(log, EPOCHS).items():
        support[k] = support.get(k, 0) + w
    assert {r["k"]: r["n"] for r in kept.table.read(spark, len(batches) - 1).collect()} == support


def gate_of(spark, folder):
    tables = dict(zip("col", logs(spark, *all_q18_changes())))
    return EpochGate(folder, {name: payload(log) for name, log in tables.items()}), tables


def q18_result(tables, last):
    return q18.by_epoch(tables["c"], tables["o"], tables["l"], last)


def shown(gate, spark, epoch):
    found = gate.read(spark).where(F.col("epoch") == epoch)
    return sorted((r.o_orderkey, int(r.sum_qty)) for r in found.collect())


def test_the_gate_waits_for_the_slowest_source(spark, folder):
    gate, tables = gate_of(spark, folder)
    assert gate.release(spark, q18_result) == gate.released(spark) == -1

    def give(name, epoch, number):
        gate.take(name)(marked(tables[name].where(F.col("epoch") == epoch), epoch), number)

    for name in "co":
        for epoch in range(3):
            give(name, epoch, epoch)
    assert gate.finished(spark) == {"c": 2, "o": 2, "l": -1}
    assert gate.release(spark, q18_result) == -1
    # Half of an epoch's lines without the mark are not enough, and are not shown.
    first = tables["l"].where("epoch = 0")
    gate.take("l")(first.where("l_orderkey < 40"), 0)
    assert gate.release(spark, q18_result) == -1
    gate.take("l")(marked(first.where("l_orderkey >= 40"), 0), 1)
    assert gate.release(spark, q18_result) == 0
    assert shown(gate, spark, 0) == all_q18_results(0)
    # The last two epochs come in one release.
    give("l", 1, 2)
    give("l", 2, 3)
    assert gate.release(spark, q18_result) == 2
    assert gate.release(spark, q18_result) == 2
    for epoch in range(3):
        assert shown(gate, spark, epoch) == all_q18_results(epoch)
        assert rows(gate.as_of(spark, "l", epoch)) == rows(snapshot(tables["l"], epoch))
    # A row after its epoch's mark is told, not mixed in.
    gate.take("c")(tables["c"].where("epoch = 0").limit(1), 3)
    assert gate.late(spark, "c").count() == 1 and gate.late(spark, "l").count() == 0


def test_a_lost_release_goes_on_with_its_own_epochs(spark, folder, monkeypatch):
    gate, tables = gate_of(spark, folder)
    for name, log in tables.items():
        gate.take(name)(marked(log.where("epoch = 0"), 0), 0)
    keep = History.step

    def lost(self, batch, number):
        if self.path.endswith("/l"):
            raise OSError("lost")
        keep(self, batch, number)

    monkeypatch.setattr(History, "step", lost)
    with pytest.raises(OSError):
        gate.release(spark, q18_result)
    monkeypatch.setattr(History, "step", keep)
    # Meanwhile all sources finish another epoch.
    for name, log in tables.items():
        gate.take(name)(marked(log.where("epoch = 1"), 1), 1)
    assert gate.release(spark, q18_result) == 0
    assert gate.release(spark, q18_result) == 1
    for epoch in range(2):
        assert shown(gate, spark, epoch) == all_q18_results(epoch)
