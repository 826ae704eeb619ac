"""

Most queries run over a change stream of the given tables: epoch 0 inserts
every row, epoch 1 deletes some and epoch 2 puts part of them back.  `CHANGES`
says which, in the same words for Spark and for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

import oracle_queries
from tidemark.functions.columns import format_day, parse_day, result_text
from tidemark.operators import zset
from tidemark.operators.audit import suspects
from tidemark.operators.having import having_changelog, having_row_changes, row_changes, row_sums
from tidemark.operators.maintain import delete_by_key, guard
from tidemark.operators.support import anti_join_changes, semi_join_changes
from tidemark.plans import joins, q3, q18
from tidemark.schemas import DELETE_KEYS, canonical
from tidemark.session import prepare, publish, work_dir, written
from tidemark.sources import table_log, text_log
from tidemark.streaming.guard import GuardedLog
from tidemark.streaming.delta import payload, stream_log
from tidemark.streaming.gate import EpochGate, marked
from tidemark.streaming.having import HavingLog
from tidemark.streaming.history import History
from tidemark.streaming.ingest import ingest
from tidemark.streaming.rolled import RolledOutput
from tidemark.streaming.rows import DeletedByKey, GuardedKeys, RunningLog
from tidemark.streaming.runner import start, to_batches

BOUND = 200
# Sums above this are off by one in the result that `epoch_audit` looks at.
PLANTED = 300
LAST_EPOCH = 2
PRIORITY = "o_orderpriority"
TAGS = ("customer", "orders", "lineitem")

# (epoch, weight, rows) after the inserts of epoch 0.
CHANGES = {
    "customer": [
        (1, -1, "c_acctbal < 0"),
        (2, 1, "c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE')"),
    ],
    "orders": [
        (1, -1, "o_orderpriority = '5-LOW'"),
        (2, 1, "o_orderpriority = '5-LOW' AND o_orderstatus = 'F'"),
    ],
    "lineitem": [
        (1, -1, "l_returnflag = 'R' AND l_linestatus = 'O'"),
        (2, 1, "l_returnflag = 'R' AND l_linestatus = 'O' AND l_shipdate < '1998-01-01'"),
    ],
    "nation": [],
}
# Customers that come twice, leave twice, or leave without having come: the
# steps, two of which make an epoch.
REPEATED = [
    (1, 1, "c_mktsegment = 'BUILDING'"),
    (2, -1, "c_acctbal < 0"),
    (3, -1, "c_acctbal < 0 AND c_mktsegment = 'BUILDING'"),
    (4, 1, "c_acctbal < 0"),
    (5, -1, "c_acctbal < 100"),
]
# Rows that epoch 0 leaves out, so that their deletes find nothing.
ORPHANS = {"customer": "c_acctbal < -500", "orders": "o_orderstatus = 'O'", "lineitem": "l_quantity > 45"}


# --- inputs -----------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The tables as they are; quantities are whole numbers, so their sums are exact."""
    customer, orders, lineitem = [_table(spark, sf_dir, tag) for tag in TAGS]
    return [customer, orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date")), lineitem]


def _which(changes: list) -> list[tuple[int, int, Column]]:
    return [(epoch, w, F.expr(text)) for epoch, w, text in changes]


def _log(spark: SparkSession, sf_dir: str, tag: str, changes: list | None = None) -> DataFrame:
    listed = CHANGES[tag] if changes is None else changes
    return table_log.changes_of_table(_table(spark, sf_dir, tag), tag, _which(listed))


def _epoch(spark: SparkSession, sf_dir: str, tag: str, epoch: int) -> DataFrame:
    """One epoch of `_log`."""
    return table_log.changes_in_epoch(_table(spark, sf_dir, tag), tag, _which(CHANGES[tag]), epoch)


def _logs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_log(spark, sf_dir, tag) for tag in TAGS]


def _orphaned_logs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The same logs with rows that are deleted, or come back, without having been inserted."""
    return [_log(spark, sf_dir, tag).where(f"NOT (epoch = 0 AND {ORPHANS[tag]})") for tag in TAGS]


def _lines(spark: SparkSession, sf_dir: str, epoch: int) -> DataFrame:
    """An epoch of the change stream as text."""
    parts = [
        text_log.to_lines(_epoch(spark, sf_dir, tag, epoch), tag)
        for tag in (*TAGS, "nation")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _text(spark: SparkSession, sf_dir: str) -> str:
    """The change stream as one text log with epoch markers; gives its path."""
    path = work_dir(spark, "text")
    for epoch in range(LAST_EPOCH + 1):
        text_log.write_marked(_lines(spark, sf_dir, epoch), path, epoch)
    return path


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_log.parse(text_log.read_lines(spark, _text(spark, sf_dir)))


class Played:
    """The change stream as files that come in epoch by epoch."""

    def __init__(self, spark: SparkSession, sf_dir: str, base: str, tags: tuple[str, ...] = TAGS,
                 missing: str = "false"):
        self.spark, self.sf_dir, self.base, self.tags = spark, sf_dir, base, tags
        # Rows that epoch 0 leaves out, so that their deletes find nothing.
        self.missing = missing
        self._write(0)

    def _write(self, epoch: int) -> None:
        for tag in self.tags:
            log = _epoch(self.spark, self.sf_dir, tag, epoch)
            if epoch == 0:
                log = log.where(f"NOT ({self.missing})")
            table_log.write_epoch(log, f"{self.base}/{tag}", epoch)

    def stream(self, tag: str) -> DataFrame:
        return table_log.stream_log(self.spark, f"{self.base}/{tag}", tag)

    def streams(self) -> list[DataFrame]:
        return [self.stream(tag) for tag in self.tags]

    def play(self, *queries: StreamingQuery) -> None:
        """Let started queries settle on epoch 0, then give them the later epochs."""
        for epoch in range(LAST_EPOCH + 1):
            if epoch:
                self._write(epoch)
            for query in queries:
                query.processAllAvailable()
        for query in queries:
            query.stop()


# --- outputs ----------------------------------------------------------------


def _plain(df: DataFrame) -> DataFrame:
    """Types every SQL engine shows alike: bigint, double, text."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "date":
            column = column.cast("string")
        columns.append(column.alias(name))
    return df.select(*columns)


# --- text logs --------------------------------------------------------------


def changelog_ingest(spark, sf_dir):
    """Changes per epoch, table and sign, as read from text."""
    records = _records(spark, sf_dir).where(text_log.reason().isNull())
    key = F.get("f", F.lit(1)).try_cast("bigint")
    counts = records.groupBy("epoch", "tag", "w").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))
    return _plain(counts)


def changelog_ingest_stream(spark, sf_dir):
    """The same, of a text log taken in by a stream, epoch by epoch, and routed to parquet."""
    text, routed = work_dir(spark, "text"), work_dir(spark, "routed")
    text_log.write_marked(_lines(spark, sf_dir, 0), text, 0)
    query = ingest(spark, text, routed, work_dir(spark, "checkpoint"), available_now=False)
    for epoch in range(LAST_EPOCH + 1):
        if epoch:
            text_log.write_marked(_lines(spark, sf_dir, epoch), text, epoch)
        query.processAllAvailable()
    query.stop()
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "nation": "n_nationkey"}
    parts = [
        table_log.read_routed(spark, routed, tag).groupBy("epoch", "w")
        .agg(F.count("*").alias("n"), F.sum(key).alias("keys"))
        .select("epoch", F.lit(tag).alias("tag"), "w", "n", "keys")
        for tag, key in keys.items()
    ]
    return _plain(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def changelog_epochs(spark, sf_dir):
    """Where each epoch lies in the log, by line number."""
    lines = text_log.read_lines(spark, _text(spark, sf_dir))
    return _plain(lines.groupBy("epoch").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_line"), F.max("seq").alias("last_line")
    ))


def changelog_route(spark, sf_dir):
    """Every typed change of the three tables."""
    records = _records(spark, sf_dir)
    shapes = {
        "customer": ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name"),
        "orders": ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "lineitem": ("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag"),
    }
    names = ("key", "other_key", "amount", "detail", "label")
    parts = [
        text_log.table_changes(records, tag).select(
            F.lit(tag).alias("tag"), "epoch", "w",
            *[F.col(c).cast("string" if n in ("detail", "label") else "double" if n == "amount" else "bigint").alias(n)
              for c, n in zip(columns, names)],
        )
        for tag, columns in shapes.items()
    ]
    return _plain(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def changelog_quarantine(spark, sf_dir):
    """Orders spoiled in one of five ways by their priority; the last way is harmless."""
    f = F.split("value", "\t")
    tab = F.lit("\t")

    def line(*parts: Column) -> Column:
        return F.array_join(F.concat(*parts), "\t")

    priority = f[6]
    spoiled = (
        F.when(priority == "1-URGENT", line(F.array(F.lit("*")), F.slice(f, 2, 10)))
        .when(priority == "2-HIGH", line(F.slice(f, 1, 10), F.array(F.lit("order"))))
        .when(priority == "3-MEDIUM", line(F.slice(f, 1, 5), F.array(F.lit("31/2/1997")), F.slice(f, 7, 5)))
        .when(priority == "4-NOT SPECIFIED", line(F.slice(f, 1, 7), F.slice(f, 9, 3)))
        .otherwise(F.concat("value", tab))
    )
    lines = text_log.to_lines(_log(spark, sf_dir, "orders", []), "orders").withColumn("value", spoiled)
    path = work_dir(spark, "spoiled")
    text_log.write_marked(lines, path, 0)
    records = text_log.parse(text_log.read_lines(spark, path))
    return _plain(text_log.quarantine(records).select("epoch", "tag", "reason", "value"))


def _changelog(tag: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        """A table's changes as read from text, in all columns that the table has."""
        changes = text_log.table_changes(_records(spark, sf_dir), tag)
        return _plain(changes.select("w", "epoch", *canonical(_table(spark, sf_dir, tag), tag).columns))

    return query


def date_roundtrip(spark, sf_dir):
    orders = canonical(_table(spark, sf_dir, "orders"), "orders")
    text = orders.select("o_orderkey", format_day(F.col("o_orderdate")).alias("day_text"))
    return _plain(text.withColumn("day", parse_day(F.col("day_text"))))


# --- tables under change ----------------------------------------------------


def snapshot_customer(spark, sf_dir):
    return _plain(zset.as_rows(zset.snapshot(_log(spark, sf_dir, "customer"))))


def snapshot_as_of(spark, sf_dir):
    return _plain(zset.snapshot(_log(spark, sf_dir, "lineitem"), epoch=1))


def snapshot_as_of_intervals(spark, sf_dir):
    """The orders at every epoch, read from intervals that a stream keeps."""
    base = work_dir(spark, "history")
    log = _log(spark, sf_dir, "orders")
    kept = History(f"{base}/kept", payload(log))
    _play_steps(spark, log, "epoch", LAST_EPOCH, base, kept.step)
    epochs = [kept.as_of(spark, LAST_EPOCH, epoch).withColumn("epoch", F.lit(epoch)) for epoch in range(LAST_EPOCH + 1)]
    return _plain(epochs[0].unionByName(epochs[1]).unionByName(epochs[2]))


def change_counts(spark, sf_dir):
    return _plain(zset.change_counts(_log(spark, sf_dir, "orders"), "o_custkey"))


def delete_by_key_query(spark, sf_dir):
    return _plain(delete_by_key(_log(spark, sf_dir, "lineitem"), DELETE_KEYS["lineitem"], ["epoch"]))


def guard_customer(spark, sf_dir):
    """Epochs with several changes of a customer, told apart by `seq`."""
    steps = _log(spark, sf_dir, "customer", REPEATED)
    steps = steps.where("NOT (epoch = 0 AND c_mktsegment = 'MACHINERY')")
    log = steps.withColumns({"seq": F.col("epoch").cast("bigint"), "epoch": F.expr("epoch div 2").cast("int")})
    return _plain(guard(log, ["c_custkey"], ["epoch", "seq"]))


def guard_customer_stream(spark, sf_dir):
    """The same guard over a stream, an epoch in two batches: a key goes on from one to the next."""
    base = work_dir(spark, "guard")
    steps = _log(spark, sf_dir, "customer", REPEATED).where("NOT (epoch = 0 AND c_mktsegment = 'MACHINERY')")
    log = steps.withColumns({"seq": F.col("epoch").cast("bigint"), "epoch": F.expr("epoch div 2").cast("int")})
    kept = GuardedKeys(f"{base}/kept", ["c_custkey"], ["epoch", "seq"])
    _play_steps(spark, log, "seq", len(REPEATED), base, kept.step)
    return _plain(spark.read.parquet(kept.log_path).drop("batch"))


def _play_steps(spark: SparkSession, log: DataFrame, step: str, last: int, base: str, take: Callable) -> None:
    """Give a stream the rows of each step in turn, as a folder that appears at once: a batch takes all of it."""
    folder, schema, query = f"{base}/in", log.schema, None
    for number in range(last + 1):
        publish(log.where(F.col(step) == number), folder, f"batch={number}")
        if query is None:
            query = start(stream_log(spark, folder, schema), f"{base}/checkpoint", "steps", to_batches(take))
        query.processAllAvailable()
    query.stop()


def delete_by_key_stream(spark, sf_dir):
    """The same table kept up by a stream, of which a batch rewrites the buckets it touches."""
    base = work_dir(spark, "deleted")
    log = _log(spark, sf_dir, "lineitem")
    kept = DeletedByKey(f"{base}/kept", DELETE_KEYS["lineitem"], ["epoch"], payload(log))
    _play_steps(spark, log, "epoch", LAST_EPOCH, base, kept.step)
    return _plain(kept.read(spark, LAST_EPOCH))


def orphan_deletes(spark, sf_dir):
    """Rows deleted without having been inserted: some orders never come in."""
    log = _log(spark, sf_dir, "orders").where("NOT (epoch = 0 AND o_orderstatus = 'P')")
    return _plain(zset.orphans(log))


def guarded_stream(spark, sf_dir):
    """What a guarded stream lets through of the same changes, netted per epoch."""
    base = work_dir(spark, "guard")
    played = Played(spark, sf_dir, base, ("orders",), missing="o_orderstatus = 'P'")
    columns = _table(spark, sf_dir, "orders").columns
    kept = GuardedLog(f"{base}/guarded", columns, compact_every=2)
    changes = played.stream("orders").select("w", "epoch", *columns)
    played.play(start(changes, f"{base}/checkpoint", "guard", to_batches(kept.step)))
    return _plain(spark.read.parquet(kept.log_path).drop("batch"))


# --- joins ------------------------------------------------------------------


def _customer_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    change = [c for c in ("w", "epoch") if c in customer.columns]
    pairs = joins.customer_orders(
        customer.select(*change, "c_custkey", "c_name"),
        orders.select(*change, "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
    )
    return pairs.select(*change, "c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


def join_customer_orders(spark, sf_dir):
    """Customers with their orders after the last epoch."""
    return _plain(zset.snapshot(_customer_orders(*[zset.snapshot(log) for log in _logs(spark, sf_dir)[:2]])))


def join_weighted_delta(spark, sf_dir):
    """What each epoch changed in the join."""
    pairs = _customer_orders(*[zset.valid(log) for log in _logs(spark, sf_dir)[:2]])
    return _plain(zset.net_changes(pairs, by_epoch=True))


def join_three_way(spark, sf_dir):
    snapshots = [zset.snapshot(log) for log in _logs(spark, sf_dir)]
    return _plain(zset.snapshot(q3.joined(*snapshots, priority=PRIORITY)))


def semi_join_large_orders(spark, sf_dir):
    _, orders, lineitem = _tables(spark, sf_dir)
    large = q18.large_orders(lineitem, BOUND)
    return _plain(orders.join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"))


def _orders_and_large(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    _, orders, lineitem = [zset.valid(log) for log in _logs(spark, sf_dir)]
    return [orders, having_changelog(lineitem, "l_orderkey", F.col("l_quantity"), BOUND)]


def semi_join_changelog(spark, sf_dir):
    """What each epoch changed among the large orders: a sum that merely changes moves no order."""
    return _plain(semi_join_changes(*_orders_and_large(spark, sf_dir), ("o_orderkey", "l_orderkey")))


def anti_join_changelog(spark, sf_dir):
    """The same of the orders that are not large."""
    return _plain(anti_join_changes(*_orders_and_large(spark, sf_dir), ("o_orderkey", "l_orderkey")))


# --- aggregates -------------------------------------------------------------


def having_large_orders(spark, sf_dir):
    return _plain(q18.large_orders(_tables(spark, sf_dir)[2], BOUND))


def having_changes(spark, sf_dir):
    log = _log(spark, sf_dir, "lineitem")
    return _plain(having_changelog(log, "l_orderkey", F.col("l_quantity"), BOUND))


def having_changes_stream(spark, sf_dir):
    """The same change log, kept up by a stream, epoch by epoch."""
    return _plain(_kept_having(spark, sf_dir))


def epoch_audit(spark, sf_dir):
    """The kept change log with wrong sums planted in it, held against the batch query: the rows that differ."""
    kept = _kept_having(spark, sf_dir).select("w", "epoch", "l_orderkey", "sum_qty")
    kept = kept.withColumn("sum_qty", F.col("sum_qty") + F.when(F.col("sum_qty") > PLANTED, 1).otherwise(0))
    wanted = having_changelog(_log(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity"), BOUND)
    types = {c: F.col(c).cast(kind) for c, kind in kept.dtypes}
    return _plain(suspects(kept, wanted.withColumns(types).select(*kept.columns), ["l_orderkey"]))


def _kept_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "having")
    played = Played(spark, sf_dir, base, ("lineitem",))
    kept = HavingLog(f"{base}/having", "l_orderkey", F.col("l_quantity"), BOUND, compact_every=2)
    changes = played.stream("lineitem").select("w", "epoch", "l_orderkey", "l_quantity")
    played.play(start(changes, f"{base}/checkpoint", "having", to_batches(kept.step)))
    return spark.read.parquet(kept.log_path).drop("batch")


def running_quantity(spark, sf_dir):
    log = _log(spark, sf_dir, "lineitem")
    order = ["epoch", *[c for c in log.columns if c not in ("w", "epoch")]]
    return _plain(having_row_changes(log, "l_orderkey", order, F.col("l_quantity"), BOUND))


def running_revenue(spark, sf_dir):
    logs = [zset.valid(log) for log in _logs(spark, sf_dir)]
    pairs = zset.net_changes(q3.joined(*logs, priority=PRIORITY), by_epoch=True)
    order = ["epoch", "c_custkey", "l_partkey", "l_extendedprice", "l_discount"]
    return _plain(q3.running(pairs, order, PRIORITY))


def running_quantity_nulls(spark, sf_dir):
    """Quantities of which some are NULL: they change no sum and give no row."""
    log = _log(spark, sf_dir, "lineitem")
    log = log.withColumn("l_quantity", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")))
    order = ["epoch", *[c for c in log.columns if c not in ("w", "epoch")]]
    return _plain(having_row_changes(log, "l_orderkey", order, F.col("l_quantity"), 100))


def running_quantity_stream(spark, sf_dir):
    """The same over a stream: each batch goes on from the keys' sums so far."""
    base = work_dir(spark, "running")
    log = _log(spark, sf_dir, "lineitem")
    order = ["epoch", *[c for c in log.columns if c not in ("w", "epoch")]]
    log = log.withColumn("change", F.col("l_quantity") * F.col("w"))
    kept = RunningLog(f"{base}/kept", ["l_orderkey"], order, row_sums(F.col("change")))
    _play_steps(spark, log, "epoch", LAST_EPOCH, base, kept.step)
    return _plain(row_changes(kept.read(spark), "l_orderkey", BOUND))


# --- Q18 --------------------------------------------------------------------


def q18_batch(spark, sf_dir):
    return _plain(q18.batch(*_tables(spark, sf_dir), bound=270))


def q18_rewritten(spark, sf_dir):
    return _plain(q18.rewritten(*_tables(spark, sf_dir)))


def q18_by_epoch(spark, sf_dir):
    return _plain(q18.by_epoch(*_logs(spark, sf_dir), last=LAST_EPOCH, bound=BOUND))


def q18_by_epoch_orphans(spark, sf_dir):
    """The same with customers, orders and lines deleted that were never there."""
    return _plain(q18.by_epoch(*_orphaned_logs(spark, sf_dir), last=LAST_EPOCH, bound=BOUND))


def q18_stream_netted(spark, sf_dir):
    """A three-way streaming join, summed and cut when read."""
    base = work_dir(spark, "stream")
    played = Played(spark, sf_dir, base)
    query = q18.start_joined(*played.streams(), f"{base}/out", f"{base}/checkpoint")
    played.play(query)
    return _plain(q18.read_joined(spark, f"{base}/out", BOUND))


def q18_stream_having(spark, sf_dir):
    """Large orders first, as a change log; then joined as streams."""
    base = work_dir(spark, "stream")
    played = Played(spark, sf_dir, base)
    customer, orders, lineitem = played.streams()
    first = q18.start_large(lineitem, f"{base}/large", f"{base}/checkpoint-large", BOUND)
    first.processAllAvailable()
    large = q18.stream_large(spark, f"{base}/large")
    second = q18.start_picked(customer, orders, large, f"{base}/out", f"{base}/checkpoint-picked")
    played.play(first, second)
    return _plain(q18.read_picked(spark, f"{base}/out"))


def q18_delta_join(spark, sf_dir):
    """Joins by changes against tables of the rows that exist: a delete frees what it deletes."""
    base = work_dir(spark, "stream")
    played = Played(spark, sf_dir, base)
    customer, orders, lineitem = played.streams()
    first = q18.start_large(lineitem, f"{base}/large", f"{base}/checkpoint-large", BOUND)
    first.processAllAvailable()
    large = q18.stream_large(spark, f"{base}/large")
    played.play(first, *q18.start_delta(customer, orders, large, f"{base}/delta", f"{base}/checkpoint"))
    return _plain(q18.read_delta(q18.delta_joins(customer, orders, large, f"{base}/delta")[1], spark))


def q18_complete_epochs(spark, sf_dir):
    """The result of each epoch, shown when the slowest of three sources has finished it."""
    base = work_dir(spark, "gate")
    logs = dict(zip(TAGS, _logs(spark, sf_dir)))
    gate = EpochGate(f"{base}/gate", {tag: payload(log) for tag, log in logs.items()})
    streams = {}

    def result(tables: dict[str, DataFrame], last: int) -> DataFrame:
        return q18.by_epoch(*[tables[tag] for tag in TAGS], last=last, bound=BOUND)

    for epoch in range(LAST_EPOCH + 1):
        for tag, log in logs.items():
            rows = marked(log.where(F.col("epoch") == epoch), epoch)
            # At once, or the stream may take the mark before rows of its epoch.
            publish(rows, f"{base}/in/{tag}", f"batch={epoch}")
            if tag not in streams:
                stream = stream_log(spark, f"{base}/in/{tag}", rows.schema)
                streams[tag] = start(stream, f"{base}/checkpoint-{tag}", f"gate-{tag}", to_batches(gate.take(tag)))
            streams[tag].processAllAvailable()
            gate.release(spark, result)
    for query in streams.values():
        query.stop()
    return _plain(gate.read(spark))


# --- Q3 ---------------------------------------------------------------------


def q3_revenue(spark, sf_dir):
    return _plain(q3.batch(*_logs(spark, sf_dir), priority=PRIORITY))


def q3_revenue_orphans(spark, sf_dir):
    """The same with customers, orders and lines deleted that were never there."""
    return _plain(q3.batch(*_orphaned_logs(spark, sf_dir), priority=PRIORITY))


def q3_filtered(spark, sf_dir):
    customer, orders, lineitem = [
        canonical(_table(spark, sf_dir, tag).withColumn("w", F.lit(1)), tag) for tag in TAGS
    ]
    customer, orders = q3.filtered(customer, orders)
    return _plain(q3.revenue_of(customer, orders, lineitem, PRIORITY))


def _q3_streams(played: Played) -> list[StreamingQuery]:
    """The two stages: lines' sums, and their join."""
    base = played.base
    customer, orders, lineitem = played.streams()
    sums = q3.start_sums(lineitem, f"{base}/sums", f"{base}/checkpoint-sums")
    sums.processAllAvailable()
    stream = q3.stream_sums(played.spark, f"{base}/sums")
    return [sums, q3.start_joined(customer, orders, stream, f"{base}/out", f"{base}/checkpoint", PRIORITY)]


def q3_stream(spark, sf_dir):
    """Revenue kept up by a stream, the lines added up before the join."""
    played = Played(spark, sf_dir, work_dir(spark, "stream"))
    played.play(*_q3_streams(played))
    return _plain(q3.read_joined(spark, f"{played.base}/out", PRIORITY))


def q3_live_tuples(spark, sf_dir):
    """Revenue of orders and lines whose parents exist, by counts of live parents."""
    base = work_dir(spark, "stream")
    played = Played(spark, sf_dir, base)
    streams = played.streams()
    played.play(*q3.start_live(*streams, f"{base}/live", f"{base}/checkpoint", PRIORITY))
    return _plain(q3.read_live(*q3.live_tuples(*streams, f"{base}/live", PRIORITY), spark, PRIORITY))


def q3_totals_stream(spark, sf_dir):
    """The same revenue from running totals in stream state, a stage after the join."""
    base = work_dir(spark, "stream")
    played = Played(spark, sf_dir, base)
    stages = _q3_streams(played)
    stages[-1].processAllAvailable()
    stages.append(q3.start_totals(spark, f"{base}/out", f"{base}/totals", f"{base}/checkpoint-totals", PRIORITY))
    played.play(*stages)
    return _plain(q3.read_totals(spark, f"{base}/totals", PRIORITY))


def result_text_query(spark, sf_dir):
    rows = q18.rewritten(*_tables(spark, sf_dir), bound=BOUND)
    text = result_text(*q18.KEYS, "sum_qty", amounts=("o_totalprice", "sum_qty"))
    return rows.select(text.alias("result"))


def rolled_output(spark, sf_dir):
    """The orders' changes as lines of files rolled by size, what is left at the end."""
    base = work_dir(spark, "rolled")
    log = _log(spark, sf_dir, "orders")
    out = RolledOutput(f"{base}/out", most_bytes=1 << 20)
    text = F.concat_ws("\t", "epoch", "w", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = log.select("epoch", text.alias("value"))
    _play_steps(spark, lines, "epoch", LAST_EPOCH, base, lambda batch, number: out.step(batch.select("value"), number))
    out.roll(spark, now=True)
    return out.read(spark)


# --- contract ---------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Q18 over the smallest test tables."""
    return q18_rewritten(prepare(spark), "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(query) for name, query in (QUERIES | LLM_QUERIES).items()}


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(prepare(spark), sf_dir)


QUERIES = {
    "changelog_ingest": changelog_ingest,
    "changelog_ingest_stream": changelog_ingest_stream,
    "changelog_epochs": changelog_epochs,
    "changelog_route": changelog_route,
    "changelog_quarantine": changelog_quarantine,
    "changelog_customer": _changelog("customer"),
    "changelog_orders": _changelog("orders"),
    "changelog_lineitem": _changelog("lineitem"),
    "changelog_nation": _changelog("nation"),
    "date_roundtrip": date_roundtrip,
    "snapshot_customer": snapshot_customer,
    "snapshot_as_of": snapshot_as_of,
    "snapshot_as_of_intervals": snapshot_as_of_intervals,
    "change_counts": change_counts,
    "delete_by_key": delete_by_key_query,
    "delete_by_key_stream": delete_by_key_stream,
    "guard_customer": guard_customer,
    "guard_customer_stream": guard_customer_stream,
    "orphan_deletes": orphan_deletes,
    "guarded_stream": guarded_stream,
    "join_customer_orders": join_customer_orders,
    "join_weighted_delta": join_weighted_delta,
    "join_three_way": join_three_way,
    "semi_join_large_orders": semi_join_large_orders,
    "semi_join_changelog": semi_join_changelog,
    "anti_join_changelog": anti_join_changelog,
    "having_large_orders": having_large_orders,
    "having_changelog": having_changes,
    "having_changelog_stream": having_changes_stream,
    "epoch_audit": epoch_audit,
    "running_quantity": running_quantity,
    "running_quantity_stream": running_quantity_stream,
    "running_quantity_nulls": running_quantity_nulls,
    "running_revenue": running_revenue,
    "q18_batch": q18_batch,
    "q18_rewritten": q18_rewritten,
    "q18_by_epoch": q18_by_epoch,
    "q18_by_epoch_orphans": q18_by_epoch_orphans,
    "q18_complete_epochs": q18_complete_epochs,
    "q18_stream_netted": q18_stream_netted,
    "q18_stream_having": q18_stream_having,
    "q18_delta_join": q18_delta_join,
    "q3_revenue": q3_revenue,
    "q3_revenue_orphans": q3_revenue_orphans,
    "q3_filtered": q3_filtered,
    "q3_stream": q3_stream,
    "q3_totals_stream": q3_totals_stream,
    "q3_live_tuples": q3_live_tuples,
    "result_text": result_text_query,
    "rolled_output": rolled_output,
}


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql(CHANGES, REPEATED, ORPHANS, BOUND, LAST_EPOCH, PLANTED) | LLM_SQL


# The training-data operators are a part of their own; all else works without them.
try:
    import corpus_pipeline
    from tidemark.llm import sql as llm_sql
    from tidemark.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    # Only these may be gone; what they themselves lack is a fault.
    if missing.name not in ("corpus_pipeline", "tidemark.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    LLM_QUERIES = LLM_QUERIES | {"pipeline": corpus_pipeline.run}
    LLM_SQL = llm_sql.ORACLES
