"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidemark.operators.zset import snapshot
from tidemark.plans import joins, q3, q18
from tidemark.schemas import TABLES, canonical
from tidemark.session import prepare, settings, work_dir
from tidemark.sources import table_log
from tidemark.streaming.state import Totals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{tag}.parquet") for tag in ("customer", "orders", "lineitem")]


def test_rewritten_q18_reads_lineitem_once_and_only_two_columns(tables):
    text = plan(q18.rewritten(*tables))
    scans = re.findall(r"FileScan parquet \[(l_[^\]]*)\]", text)
    assert len(scans) == 1
    assert set(re.findall(r"(l_[a-z]+)#", scans[0])) == {"l_orderkey", "l_quantity"}
    assert "partial_sum" in text


def test_q3_filters_reach_the_scans(spark, tables):
    customer, orders, lineitem = [
        canonical(df, tag).withColumn("w", F.lit(1)) for df, tag in zip(tables, ("customer", "orders", "lineitem"))
    ]
    customer, orders = q3.filtered(customer, orders)
    text = plan(q3.result(q3.joined(customer, orders, lineitem, "o_orderpriority"), "o_orderpriority"))
    assert "EqualTo(c_mktsegment,AUTOMOBILE)" in text
    assert "l_returnflag" not in text and "l_tax" not in text


def test_snapshot_reads_only_its_epochs(spark, folder, tables):
    log = table_log.changes_of_table(tables[0], "customer", [(1, -1, F.col("c_acctbal") < 0)])
    for epoch in (0, 1):
        table_log.write_epoch(log, folder, epoch)
    early = snapshot(table_log.read_log(spark, folder, "customer"), epoch=0)
    assert re.search(r"PartitionFilters: \[[^\]]*epoch#\d+ <= 0", plan(early))
    assert early.count() == tables[0].count()


def test_netting_sums_before_the_shuffle(spark, tables):
    log = table_log.changes_of_table(tables[0], "customer", [])
    assert "partial_sum" in plan(snapshot(log))


def test_no_cross_join_or_python_in_the_plans(spark, tables):
    logs = [table_log.changes_of_table(df, tag, []) for df, tag in zip(tables, TABLES)]
    for df in (q18.by_epoch(*logs, last=2), q18.batch(*tables), q3.joined(*logs, "o_orderpriority")):
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def test_a_heavy_customer_is_split_also_below_a_net(spark):
    """One customer holds a third of the orders; the join is split and the net still right."""
    orders = spark.range(30_000).select(
        F.lit(1).alias("w"), F.lit(0).alias("epoch"), F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("bigint").alias("o_custkey"))
    customer = spark.range(500).select(
        F.lit(1).alias("w"), F.lit(0).alias("epoch"), F.col("id").alias("c_custkey"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    with settings(spark, small):
        prepare(spark)
        net = snapshot(joins.customer_orders(customer, orders.repartition(8)))
        assert len(net.collect()) == 30_000
        assert "skew=true" in plan(net)


def test_totals_read_only_the_buckets_of_the_keys_touched(spark, folder):
    totals = Totals(folder, ["k"], {"total": F.col("v")}, compact_every=2, buckets=16)
    for number in range(2):
        totals.add(spark.range(200).selectExpr("1 AS w", f"{number} AS epoch", "id AS k", "id AS v"), number)
        totals.compact(spark, number)
    sums = totals.add(spark.range(1).selectExpr("1 AS w", "2 AS epoch", "7L AS k", "1L AS v"), 2)
    before = totals.before(sums, 2)
    assert [(r.k, r.n, r.total, r.epoch) for r in before.collect()] == [(7, 2, 14, -1)]
    bucket = sums.select(totals._bucket()).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\)", plan(before))


def test_work_goes_where_the_session_says(spark, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(f"{base}/x-")
    assert work_dir(spark, "x") != work_dir(spark, "x")
    with settings(spark, {"tidemark.note": "kept"}):
        assert spark.conf.get("tidemark.note") == "kept"
