"""The tables a change log may carry: columns, types and keys."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType, StringType, StructType

KEY, INT, MONEY, DAY, TEXT = LongType(), IntegerType(), DecimalType(15, 2), DateType(), StringType()


def _schema(**columns) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


# Column order and types of one log record, per table tag.
TABLES = {
    "customer": _schema(
        c_custkey=KEY, c_name=TEXT, c_address=TEXT, c_nationkey=INT, c_phone=TEXT,
        c_acctbal=MONEY, c_mktsegment=TEXT, c_comment=TEXT,
    ),
    "orders": _schema(
        o_orderkey=KEY, o_custkey=KEY, o_orderstatus=TEXT, o_totalprice=MONEY, o_orderdate=DAY,
        o_orderpriority=TEXT, o_clerk=TEXT, o_shippriority=INT, o_comment=TEXT,
    ),
    "lineitem": _schema(
        l_orderkey=KEY, l_partkey=KEY, l_suppkey=KEY, l_linenumber=INT, l_quantity=MONEY,
        l_extendedprice=MONEY, l_discount=MONEY, l_tax=MONEY, l_returnflag=TEXT, l_linestatus=TEXT,
        l_shipdate=DAY, l_commitdate=DAY, l_receiptdate=DAY, l_shipinstruct=TEXT, l_shipmode=TEXT,
        l_comment=TEXT,
    ),
    "nation": _schema(n_nationkey=INT, n_name=TEXT, n_regionkey=INT, n_comment=TEXT),
}

# The columns a delete-by-key compares, per table tag.
DELETE_KEYS = {
    "customer": ["c_custkey", "c_name"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey"],
    "nation": ["n_nationkey", "n_name"],
}

# Columns that say when a change happened, not what changed.
CHANGE_COLUMNS = ("w", "epoch", "seq", "place")


def identity_columns(log: DataFrame) -> list[str]:
    """The payload columns of a log: two changes equal on them are about one row."""
    return [c for c in log.columns if c not in CHANGE_COLUMNS]


def canonical(df: DataFrame, tag: str) -> DataFrame:
    """Columns of `tag` in record order and with its types, as far as `df` has them.

    Other columns of `df` (weights, epochs) keep their place in front.
    """
    typed = [
        F.col(field.name).cast(field.dataType).alias(field.name)
        for field in TABLES[tag]
        if field.name in df.columns
    ]
    return df.select(*[c for c in df.columns if c in CHANGE_COLUMNS], *typed)
