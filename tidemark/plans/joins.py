"""The joins both queries share, on logs and on streams."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.lanes import deal, repeat
from tidemark.operators.zset import weighted_join


def customer_orders(customer: DataFrame, orders: DataFrame, lanes: int | None = None) -> DataFrame:
    """Customers with their orders."""
    return _one_to_many(customer, orders, "c_custkey", "o_custkey", lanes)


def customer_orders_lines(customer: DataFrame, orders: DataFrame, lineitem: DataFrame,
                          lanes: int | None = None, line_lanes: int | None = None) -> DataFrame:
    """Customers with their orders and the orders' lines.

    `line_lanes` spreads an order's lines.  A state holds every order once in each, and an
    order has few lines, so only a log with very long orders needs any.
    """
    pairs = customer_orders(customer, orders, lanes)
    return _one_to_many(pairs, lineitem, "o_orderkey", "l_orderkey", line_lanes)


def _one_to_many(one: DataFrame, many: DataFrame, one_key: str, many_key: str, lanes: int | None) -> DataFrame:
    """`lanes`, for streams: over how many to spread each key's rows."""
    on = [(one_key, many_key)]
    if lanes is None:
        return weighted_join(one.drop("place"), many.drop("place"), on)
    return weighted_join(repeat(one, lanes), deal(many, lanes), [*on, ("lane", "many_lane")]).drop("lane", "many_lane")


def streamed(spark: SparkSession, out: str, epoch: int | None = None) -> DataFrame:
    """What a streaming join has written so far, up to an epoch.

    These are signed rows: they mean something only once netted or summed.
    """
    rows = spark.read.parquet(out)
    return rows if epoch is None else rows.where(F.col("epoch") <= epoch)
