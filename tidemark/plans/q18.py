"""Q18: customers and their orders whose total quantity is above a bound."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.having import having, having_changelog
from tidemark.operators.lanes import LANES
from tidemark.operators.zset import at_epochs, existing, net_changes, signed_sum, snapshot, valid, weighted_join
from tidemark.plans.joins import customer_orders_lines, streamed
from tidemark.streaming.delta import DeltaJoin, both, payload
from tidemark.streaming.having import HavingLog, log_path
from tidemark.streaming.runner import start, to_batches, to_parquet

BOUND = 300
KEYS = ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]

SQL = """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice,
       sum(l_quantity) AS sum_qty
FROM {customer} AS c, {orders} AS o, {lineitem} AS l
WHERE c_custkey = o_custkey
  AND o_orderkey = l_orderkey
  AND o_orderkey IN (SELECT l_orderkey FROM {lineitem}
                     GROUP BY l_orderkey HAVING sum(l_quantity) > :bound)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
"""


def batch(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, bound: float = BOUND) -> DataFrame:
    """The query as SQL over three tables."""
    return customer.sparkSession.sql(
        SQL, args={"bound": bound}, customer=customer, orders=orders, lineitem=lineitem
    )


def large_orders(lineitem: DataFrame, bound: float = BOUND) -> DataFrame:
    """``(l_orderkey, sum_qty)`` of the orders above the bound."""
    return having(lineitem, "l_orderkey", F.col("l_quantity"), bound)


def rewritten(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, bound: float = BOUND) -> DataFrame:
    """The query with one pass over lineitem: the subquery's sum is the result's.

    Right because an order key names one order, so that grouping by the order
    adds up the same lines.
    """
    large = large_orders(lineitem, bound)
    picked = orders.join(large, F.col("o_orderkey") == F.col("l_orderkey"))
    return picked.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(*KEYS, "sum_qty")


# --- over change logs -------------------------------------------------------


def _moves(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, bound: float) -> DataFrame:
    customer, orders, lineitem = valid(customer), valid(orders), valid(lineitem)
    large = having_changelog(lineitem, "l_orderkey", F.col("l_quantity"), bound)
    return _picked(customer, orders, large)


def _picked(customer: DataFrame, orders: DataFrame, large: DataFrame) -> DataFrame:
    """The large orders first, as they are few; then their customers."""
    picked = weighted_join(_orders(orders).drop("place"), large, [("o_orderkey", "l_orderkey")])
    moves = weighted_join(_customers(customer).drop("place"), picked, [("c_custkey", "o_custkey")])
    return moves.select("w", "epoch", *KEYS, "sum_qty")


def changes(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, bound: float = BOUND) -> DataFrame:
    """The query's own change log ``(w, epoch, ..., sum_qty)``.

    Deletes of absent rows in the logs do no harm.
    """
    return net_changes(_moves(customer, orders, lineitem, bound), by_epoch=True)


def by_epoch(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, last: int,
             bound: float = BOUND) -> DataFrame:
    """The query's result at the end of each epoch, in one pass over the logs."""
    return at_epochs(_moves(customer, orders, lineitem, bound), last).drop("w")


def result(pairs: DataFrame, bound: float = BOUND) -> DataFrame:
    """The query over the weighted join of all three logs."""
    groups = signed_sum(pairs, KEYS, {"sum_qty": F.col("l_quantity")})
    return existing(groups).where(F.col("sum_qty") > bound)


def _customers(log: DataFrame) -> DataFrame:
    return log.select(*_change(log), "c_custkey", "c_name")


def _orders(log: DataFrame) -> DataFrame:
    return log.select(*_change(log), "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def _lines(log: DataFrame) -> DataFrame:
    return log.select(*_change(log), "l_orderkey", "l_quantity")


def _change(log: DataFrame) -> list[str]:
    return [c for c in ("w", "epoch", "place") if c in log.columns]


# --- over streams -----------------------------------------------------------


def start_joined(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, out: str, checkpoint: str,
                 available_now: bool = False, lanes: int | None = LANES,
                 state_partitions: int | None = None, line_lanes: int | None = None) -> StreamingQuery:
    """Join the three streams; read the result with `read_joined`.

    The join keeps every line in its state.  `start_large` and `start_picked`
    together need far less.
    """
    pairs = customer_orders_lines(_customers(customer), _orders(orders), _lines(lineitem), lanes, line_lanes)
    pairs = pairs.select("w", "epoch", *KEYS, "l_quantity")
    return start(pairs, checkpoint, "q18-joined", to_parquet(out), available_now, state_partitions)


def read_joined(spark: SparkSession, out: str, bound: float = BOUND, epoch: int | None = None) -> DataFrame:
    return result(streamed(spark, out, epoch), bound)


def start_large(lineitem: DataFrame, path: str, checkpoint: str, bound: float = BOUND,
                available_now: bool = False, state_partitions: int | None = None) -> StreamingQuery:
    """First stage: the change log of the orders above the bound."""
    log = HavingLog(path, "l_orderkey", F.col("l_quantity"), bound)
    return start(_lines(lineitem), checkpoint, "q18-large", to_batches(log.step), available_now, state_partitions)


def stream_large(spark: SparkSession, path: str) -> DataFrame:
    """The first stage's log as a stream; wants its first batch to be there."""
    log = log_path(path)
    return spark.readStream.schema(spark.read.parquet(log).schema).parquet(log).drop("batch")


def start_picked(customer: DataFrame, orders: DataFrame, large: DataFrame, out: str, checkpoint: str,
                 available_now: bool = False, state_partitions: int | None = None) -> StreamingQuery:
    """Second stage: orders joined with the large-order log, then with customers.

    The second join's state holds the picked orders only, so no key is heavy.
    """
    rows = _picked(customer, orders, large)
    return start(rows, checkpoint, "q18-picked", to_parquet(out), available_now, state_partitions)


def read_picked(spark: SparkSession, out: str, epoch: int | None = None) -> DataFrame:
    rows = net_changes(streamed(spark, out, epoch).drop("epoch"))
    return rows.where(F.col("w") > 0).drop("w")


# --- over streams, with tables of what exists -------------------------------


def delta_joins(customer: DataFrame, orders: DataFrame, large: DataFrame, path: str) -> tuple[DeltaJoin, DeltaJoin]:
    """Orders with their large sums, and customers with these: each side kept as the rows that exist."""
    orders, customer = payload(_orders(orders)), payload(_customers(customer))
    picked = DeltaJoin(f"{path}/picked", orders, payload(large), ("o_orderkey", "l_orderkey"))
    found = payload_of_log(picked)
    return picked, DeltaJoin(f"{path}/found", customer, found, ("c_custkey", "o_custkey"))


def payload_of_log(join: DeltaJoin):
    return type(join.left)([*join.left.fields, *join.right.fields])


def start_delta(customer: DataFrame, orders: DataFrame, large: DataFrame, path: str, checkpoint: str,
                available_now: bool = False) -> list[StreamingQuery]:
    """After `start_large`: both joins, the second on the first's log.  Read with `read_delta`."""
    picked, found = delta_joins(customer, orders, large, path)
    inputs = [both(_orders(orders), large), both(_customers(customer), picked.stream(customer.sparkSession))]
    return [
        start(stream, f"{checkpoint}-{name}", f"q18-{name}", to_batches(join.step), available_now)
        for name, stream, join in zip(("picked-delta", "found-delta"), inputs, (picked, found))
    ]


def read_delta(found: DeltaJoin, spark: SparkSession, epoch: int | None = None) -> DataFrame:
    """The result of the second of `delta_joins`, maybe as of an epoch."""
    return snapshot(found.read(spark), epoch).select(*KEYS, "sum_qty")
