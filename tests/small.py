"""Small hand-written change logs of customers (c), orders (o) and lines (l)."""

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "c": "w int, epoch int, c_custkey bigint, c_name string, c_mktsegment string",
    "o": "w int, epoch int, o_orderkey bigint, o_custkey bigint, o_orderdate date, "
         "o_totalprice decimal(15,2), o_shippriority int",
    "l": "w int, epoch int, l_orderkey bigint, l_partkey bigint, l_quantity decimal(15,2), "
         "l_extendedprice decimal(15,2), l_discount decimal(15,2)",
}


def c(w, epoch, key):
    return ("c", (w, epoch, key, f"Customer {key}", "AUTOMOBILE"))


def o(w, epoch, key, customer=1):
    return ("o", (w, epoch, key, customer, date(1995, 1, 1), Decimal("10.50"), 0))


def l(w, epoch, order, quantity=1, part=1, price="100.00", discount="0.10"):
    return ("l", (w, epoch, order, part, Decimal(quantity), Decimal(price), Decimal(discount)))


def logs(spark: SparkSession, *changes) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(
        spark.createDataFrame([row for kind, row in changes if kind == tag], SCHEMAS[tag])
        for tag in ("c", "o", "l")
    )


# name, changes, expected (order, sum) at the end of each epoch for bound 300
Q18_CASES = [
    ("cross_up", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 200), l(1, 1, 1, 150, 2), l(1, 2, 1, 10, 3)],
     [[], [(1, 350)], [(1, 360)]]),
    ("cross_down", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 200), l(1, 0, 1, 150, 2), l(-1, 1, 1, 150, 2)],
     [[(1, 350)], []]),
    ("strict_bound", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 300)], [[]]),
    ("reinsert", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 301), c(-1, 1, 1), c(1, 2, 1)],
     [[(1, 301)], [], [(1, 301)]]),
    ("both_deleted", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 301), o(-1, 1, 1), c(-1, 1, 1)],
     [[(1, 301)], []]),
    ("order_after_delete", [c(1, 0, 1), c(-1, 1, 1), o(1, 2, 1), l(1, 2, 1, 301)], [[], [], []]),
    ("same_sum_again", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 301), l(-1, 1, 1, 301), l(1, 1, 1, 301, 2)],
     [[(1, 301)], [(1, 301)]]),
    ("all_lines_gone", [c(1, 0, 1), o(1, 0, 1), l(1, 0, 1, 301), l(-1, 1, 1, 301)], [[(1, 301)], []]),
    ("many_copies", [c(1, 0, 1), o(1, 0, 1)] + [l(1, 0, 1, 100)] * 4 + [l(-1, 1, 1, 100)] * 2,
     [[(1, 400)], []]),
]


def all_q18_changes():
    """The changes of all cases in one log, each with keys of its own."""
    for number, (_, changes, _) in enumerate(Q18_CASES):
        base = 10 * number
        for kind, row in changes:
            row = list(row)
            row[2] += base
            if kind == "o":
                row[3] += base
            yield kind, tuple(row)


def all_q18_results(epoch):
    """What `all_q18_changes` gives at the end of an epoch; a case's last result stays."""
    return sorted(
        (10 * number + order, total)
        for number, (_, _, expected) in enumerate(Q18_CASES)
        for order, total in expected[min(epoch, len(expected) - 1)]
    )
