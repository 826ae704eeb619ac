"""Short change logs as text, after the shapes of public samples: what they net to, epoch by epoch."""

from decimal import Decimal

from tidemark.operators import zset
from tidemark.plans import joins, q18
from tidemark.sources import text_log

CUSTOMER = "{0}\t{1}\tCustomer#{1:09d}\tx\t5\tx\t1.00\tBUILDING\tx\tcustomer"
ORDER = "{0}\t{1}\t{2}\tO\t{3}\t{4}\t5-LOW\tx\t0\tx\torders"
LINE = "{0}\t{1}\t1\t1\t1\t{2}\t10.00\t0.00\t0.00\tN\tO\t1/1/1997\t1/1/1997\t1/1/1997\tx\tx\tx\tlineitem"


def logs_of(spark, path, *epochs):
    path.write_text("".join("\n".join(lines) + "\nBye\n" for lines in epochs) + "End\n")
    records = text_log.parse(text_log.read_lines(spark, str(path)))
    return [text_log.table_changes(records, tag).drop("seq") for tag in ("customer", "orders", "lineitem")]


def live_pairs(customer, orders, epoch):
    pairs = joins.customer_orders(zset.snapshot(customer, epoch), zset.snapshot(orders, epoch))
    return sorted((r.c_custkey, r.o_orderkey) for r in pairs.collect())


def test_an_order_deleted_that_never_came(spark, tmp_path):
    """Nine lines, two epochs: the second deletes a customer and an absent order."""
    customer, orders, lines = logs_of(
        spark, tmp_path / "log.txt",
        [ORDER.format("+", 4421, 10, "258779.02", "4/4/1997"), LINE.format("+", 4423, 18),
         CUSTOMER.format("+", 10), CUSTOMER.format("+", 11)],
        [CUSTOMER.format("-", 10), ORDER.format("-", 4423, 11, "1.00", "1/1/1997"), LINE.format("+", 4421, 18)])
    pair = joins.customer_orders(zset.snapshot(customer, 0), zset.snapshot(orders, 0)).first()
    assert (pair.c_name, pair.o_orderkey, str(pair.o_orderdate), pair.o_totalprice) == (
        "Customer#000000010", 4421, "1997-04-04", Decimal("258779.02"))
    assert live_pairs(customer, orders, 1) == []
    assert [(r.o_orderkey, r.w) for r in zset.orphans(orders).collect()] == [(4423, -1)]
    assert [r.c_custkey for r in zset.snapshot(customer).collect()] == [11]
    assert sorted((r.l_orderkey, int(r.l_quantity)) for r in zset.snapshot(lines).collect()) == [(4421, 18), (4423, 18)]
    assert q18.by_epoch(customer, orders, lines, 1, bound=0).isEmpty()


def test_a_customer_leaves_with_four_orders(spark, tmp_path):
    """Nine customers of whom three have orders; then one of them and an order of another go."""
    owned = {100: (2850, 2881, 3651, 5665), 112: (1191, 3745, 4544, 5254), 128: (1318,)}
    first = [CUSTOMER.format("+", k) for k in (*owned, 1, 2, 3, 4, 5, 6)]
    first += [ORDER.format("+", o, c, "10.00", "1/1/1996") for c, own in owned.items() for o in own]
    first += [ORDER.format("+", o, 900, "10.00", "1/1/1996") for o in range(132)]
    customer, orders, _ = logs_of(
        spark, tmp_path / "log.txt", first, [CUSTOMER.format("-", 100), ORDER.format("-", 5254, 112, "10.00", "1/1/1996")])
    assert live_pairs(customer, orders, 0) == sorted((c, o) for c, own in owned.items() for o in own)
    assert live_pairs(customer, orders, 1) == [(112, 1191), (112, 3745), (112, 4544), (128, 1318)]
    moves = zset.net_changes(joins.customer_orders(zset.valid(customer), zset.valid(orders)), by_epoch=True)
    assert sorted((r.epoch, r.w) for r in moves.where("epoch = 1").collect()) == [(1, -1)] * 5
