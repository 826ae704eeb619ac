"""SQL for each registered query, written over netted tables rather than weights."""

COLUMNS = {
    "customer": ["c_custkey", "c_name", "CAST(c_nationkey AS BIGINT) AS c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
               "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber",
                 "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate"],
    "nation": ["CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name", "CAST(n_regionkey AS BIGINT) AS n_regionkey"],
}
Q18_KEYS = "c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice"
Q3_KEYS = "o_orderkey, o_orderdate, o_orderpriority"
MONEY = "CAST({} AS DECIMAL(15,2))"
REVENUE = (f"CAST({MONEY.format('l_extendedprice')} * (1 - {MONEY.format('l_discount')}) AS DECIMAL(18,4))")


def names(tag: str) -> str:
    return ", ".join(c.split(" AS ")[-1] if " AS " in c else c for c in COLUMNS[tag])


def table(tag: str) -> str:
    return f"(SELECT {', '.join(COLUMNS[tag])} FROM {tag})"


def log(tag: str, changes: list) -> str:
    columns = ", ".join(COLUMNS[tag])
    parts = [f"SELECT CAST(0 AS BIGINT) AS epoch, CAST(1 AS BIGINT) AS w, {columns} FROM {tag}"]
    parts += [
        f"SELECT CAST({epoch} AS BIGINT), CAST({w} AS BIGINT), {columns} FROM {tag} WHERE {which}"
        for epoch, w, which in changes
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def oracle_sql(changes: dict, repeated: list, orphans: dict, bound: int, last: int, planted: int) -> dict[str, str]:
    logs = {tag: log(tag, changes[tag]) for tag in COLUMNS}

    def live(tag: str, epoch: int = last, without: str = "false") -> str:
        """The rows of a table that exist after an epoch; epoch 0 may leave some out."""
        return (f"(SELECT {names(tag)} FROM {logs[tag]} WHERE epoch <= {epoch} AND NOT (epoch = 0 AND {without}) "
                "GROUP BY ALL HAVING sum(w) > 0)")

    def pairs(epoch: int = last) -> str:
        return (f"(SELECT {Q18_KEYS} FROM {live('customer', epoch)} c JOIN {live('orders', epoch)} o "
                "ON c_custkey = o_custkey)")

    def large(epoch: int) -> str:
        return (f"(SELECT l_orderkey, sum(l_quantity) AS sum_qty FROM {live('lineitem', epoch)} "
                f"GROUP BY l_orderkey HAVING sum(l_quantity) > {bound})")

    def q18(customer: str, orders: str, lineitem: str, above: int) -> str:
        return (f"SELECT {Q18_KEYS}, sum(l_quantity) AS sum_qty FROM {customer} c, {orders} o, {lineitem} l "
                "WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_orderkey IN "
                f"(SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > {above}) "
                f"GROUP BY {Q18_KEYS}")

    def by_large(within: str):
        return lambda epoch: (f"(SELECT * FROM {live('orders', epoch)} WHERE o_orderkey {within} "
                              f"(SELECT l_orderkey FROM {large(epoch)}))")

    def orphaned(epoch: int) -> list[str]:
        return [live(tag, epoch, orphans[tag]) for tag in ("customer", "orders", "lineitem")]

    def q18_at(epoch: int) -> str:
        return q18(live("customer", epoch), live("orders", epoch), live("lineitem", epoch), bound)

    def q3(customer: str, orders: str, lineitem: str, where: str = "") -> str:
        return (f"SELECT {Q3_KEYS}, CAST(sum({REVENUE}) AS DOUBLE) AS revenue "
                f"FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey "
                f"JOIN {lineitem} l ON o_orderkey = l_orderkey {where} GROUP BY {Q3_KEYS}")

    def steps(state, columns: str) -> str:
        """What each epoch adds to and takes from a result that `state` gives per epoch."""
        parts = []
        for epoch in range(last + 1):
            now = f"SELECT {columns} FROM {state(epoch)}"
            before = f"SELECT {columns} FROM {state(epoch - 1)}"
            for w, a, b in ((1, now, before), (-1, before, now)):
                parts.append(f"SELECT CAST({epoch} AS BIGINT) AS epoch, CAST({w} AS BIGINT) AS w, * "
                             f"FROM ({a} EXCEPT {b})")
        return " UNION ALL ".join(parts)

    keyed = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "nation": "n_nationkey"}
    ingest = " UNION ALL ".join(
        f"SELECT epoch, '{tag}' AS tag, w, count(*) AS n, CAST(sum({key}) AS BIGINT) AS keys "
        f"FROM {logs[tag]} GROUP BY epoch, w"
        for tag, key in keyed.items()
    )
    tables = [table(tag) for tag in ("customer", "orders", "lineitem")]
    lives = [live(tag) for tag in ("customer", "orders", "lineitem")]
    route = {
        "customer": "c_custkey, c_nationkey, c_acctbal, c_mktsegment, c_name",
        "orders": "o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority",
        "lineitem": "l_orderkey, l_partkey, l_extendedprice, l_shipdate, l_returnflag",
    }
    repeated_log = f"(SELECT * FROM {log('customer', repeated)} WHERE NOT (epoch = 0 AND c_mktsegment = 'MACHINERY'))"
    joined_changes = (
        f"SELECT greatest(c.epoch, o.epoch, l.epoch) AS epoch, sum(c.w * o.w * l.w) AS w, c_custkey, {Q3_KEYS}, "
        f"l_partkey, l_extendedprice, l_discount FROM {logs['customer']} c JOIN {logs['orders']} o "
        f"ON c_custkey = o_custkey JOIN {logs['lineitem']} l ON o_orderkey = l_orderkey "
        "GROUP BY ALL HAVING sum(c.w * o.w * l.w) <> 0"
    )
    ordered = f"PARTITION BY l_orderkey ORDER BY epoch, {names('lineitem')} ROWS UNBOUNDED PRECEDING"
    ordered_nulls = ordered.replace("l_quantity", "l_quantity NULLS FIRST")
    having_log = steps(large, "l_orderkey, sum_qty")
    order_text = (
        "o_orderkey || chr(9) || o_custkey || chr(9) || o_orderstatus || chr(9) || "
        "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || chr(9)"
    )
    day_text = "strftime(o_orderdate, '%d/%m/%Y') || chr(9)"
    rest = "o_orderpriority || chr(9) || chr(9) || '0' || chr(9) || chr(9)"

    found = {
        "changelog_ingest": ingest,
        "changelog_ingest_stream": ingest,
        "changelog_epochs": (
            f"WITH lines AS ({ingest}), per AS (SELECT epoch, CAST(sum(n) AS BIGINT) AS n FROM lines GROUP BY epoch) "
            "SELECT epoch, n, CAST(sum(n + 1) OVER (ORDER BY epoch) - n - 1 AS BIGINT) AS first_line, "
            "CAST(sum(n + 1) OVER (ORDER BY epoch) - 2 AS BIGINT) AS last_line FROM per"
        ),
        "changelog_route": " UNION ALL ".join(
            f"SELECT '{tag}' AS tag, epoch, w, {', '.join(f'{c} AS {n}' for c, n in zip(columns.split(', '), ('key', 'other_key', 'amount', 'detail', 'label')))} FROM {logs[tag]}"
            for tag, columns in route.items()
        ),
        "changelog_quarantine": (
            "SELECT CAST(0 AS BIGINT) AS epoch, CASE o_orderpriority WHEN '2-HIGH' THEN 'order' ELSE 'orders' END AS tag, "
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'change flag' WHEN '2-HIGH' THEN 'unknown table' "
            "WHEN '3-MEDIUM' THEN 'bad value' ELSE 'field count' END AS reason, "
            f"CASE o_orderpriority WHEN '1-URGENT' THEN '*' || chr(9) || {order_text} || {day_text} || {rest} || 'orders' "
            f"WHEN '2-HIGH' THEN '+' || chr(9) || {order_text} || {day_text} || {rest} || 'order' "
            f"WHEN '3-MEDIUM' THEN '+' || chr(9) || {order_text} || '31/2/1997' || chr(9) || {rest} || 'orders' "
            f"ELSE '+' || chr(9) || {order_text} || {day_text} || o_orderpriority || chr(9) || '0' || chr(9) || chr(9) || 'orders' END AS value "
            "FROM orders WHERE o_orderpriority <> '5-LOW'"
        ),
        **{f"changelog_{tag}": f"SELECT w, epoch, {names(tag)} FROM {logs[tag]}" for tag in COLUMNS},
        "date_roundtrip": (
            "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day_text, "
            "strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
        ),
        "snapshot_customer": f"SELECT * FROM {live('customer')}",
        "snapshot_as_of": f"SELECT *, CAST(1 AS BIGINT) AS w FROM {live('lineitem', 1)}",
        "snapshot_as_of_intervals": " UNION ALL ".join(
            f"SELECT *, CAST(1 AS BIGINT) AS w, CAST({e} AS BIGINT) AS epoch FROM {live('orders', e)}"
            for e in range(last + 1)
        ),
        "change_counts": (
            "SELECT o_custkey, count(*) FILTER (WHERE w > 0) AS inserts, count(*) FILTER (WHERE w < 0) AS deletes, "
            f"CAST(sum(w) AS BIGINT) AS live FROM {logs['orders']} GROUP BY o_custkey"
        ),
        "delete_by_key": (
            f"SELECT {names('lineitem')} FROM {logs['lineitem']} i WHERE w > 0 AND NOT EXISTS "
            f"(SELECT 1 FROM {logs['lineitem']} d WHERE d.w < 0 AND d.l_orderkey = i.l_orderkey "
            "AND d.l_partkey = i.l_partkey AND d.epoch >= i.epoch)"
        ),
        "guard_customer": (
            f"SELECT w, epoch // 2 AS epoch, epoch AS seq, {names('customer')} FROM (SELECT *, coalesce(lag(w) OVER "
            f"(PARTITION BY c_custkey ORDER BY epoch), -1) AS before FROM {repeated_log}) WHERE w <> before"
        ),
        "orphan_deletes": (
            f"SELECT {names('orders')}, CAST(sum(w) AS BIGINT) AS w FROM {logs['orders']} "
            "WHERE NOT (epoch = 0 AND o_orderstatus = 'P') GROUP BY ALL HAVING sum(w) < 0"
        ),
        "guarded_stream": (
            f"WITH l AS (SELECT * FROM {logs['orders']} WHERE NOT (epoch = 0 AND o_orderstatus = 'P')), "
            f"c AS (SELECT *, greatest(sum(w) OVER (PARTITION BY {names('orders')} ORDER BY epoch), 0) AS live FROM l), "
            f"d AS (SELECT {names('orders')}, epoch, live - coalesce(lag(live) OVER "
            f"(PARTITION BY {names('orders')} ORDER BY epoch), 0) AS w FROM c) "
            f"SELECT CAST(w AS BIGINT) AS w, epoch, {names('orders')} FROM d WHERE w <> 0"
        ),
        "join_customer_orders": f"SELECT *, CAST(1 AS BIGINT) AS w FROM {pairs()}",
        "join_weighted_delta": steps(pairs, Q18_KEYS),
        "join_three_way": (
            f"SELECT c_custkey, {Q3_KEYS}, l_partkey, l_extendedprice, l_discount, count(*) AS w FROM {lives[0]} c "
            f"JOIN {lives[1]} o ON c_custkey = o_custkey JOIN {lives[2]} l ON o_orderkey = l_orderkey GROUP BY ALL"
        ),
        "semi_join_large_orders": (
            f"SELECT * FROM {tables[1]} WHERE o_orderkey IN "
            f"(SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > {bound})"
        ),
        "semi_join_changelog": steps(by_large("IN"), names("orders")),
        "anti_join_changelog": steps(by_large("NOT IN"), names("orders")),
        "having_large_orders": (
            "SELECT l_orderkey, sum(l_quantity) AS sum_qty FROM lineitem "
            f"GROUP BY l_orderkey HAVING sum(l_quantity) > {bound}"
        ),
        "having_changelog": having_log,
        "having_changelog_stream": having_log,
        "epoch_audit": (
            "SELECT epoch, CAST(sum(w) AS BIGINT) AS w, l_orderkey, sum_qty FROM ("
            f"SELECT epoch, w, l_orderkey, sum_qty + 1 AS sum_qty FROM ({having_log}) WHERE sum_qty > {planted} UNION ALL "
            f"SELECT epoch, -w, l_orderkey, sum_qty FROM ({having_log}) WHERE sum_qty > {planted}) "
            "GROUP BY ALL HAVING sum(w) <> 0"
        ),
        "running_quantity": (
            "WITH sums AS (SELECT *, sum(w * l_quantity) OVER win AS total, sum(w) OVER win AS n, "
            f"row_number() OVER win AS place FROM {logs['lineitem']} WINDOW win AS ({ordered})), "
            f"shown AS (SELECT *, CASE WHEN n > 0 AND total > {bound} THEN total END AS now FROM sums), "
            "moves AS (SELECT *, lag(now) OVER (PARTITION BY l_orderkey ORDER BY place) AS before FROM shown) "
            "SELECT l_orderkey, epoch, CAST(-1 AS BIGINT) AS w, before AS sum_qty FROM moves "
            "WHERE before IS NOT NULL AND now IS DISTINCT FROM before UNION ALL "
            "SELECT l_orderkey, epoch, CAST(1 AS BIGINT), now FROM moves "
            "WHERE now IS NOT NULL AND now IS DISTINCT FROM before"
        ),
        "running_quantity_nulls": (
            "WITH l AS (SELECT * REPLACE (CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS l_quantity) "
            f"FROM {logs['lineitem']}), sums AS (SELECT *, sum(w * l_quantity) OVER win AS total, sum(w) OVER win AS n, "
            f"row_number() OVER win AS place FROM l WINDOW win AS ({ordered_nulls})), "
            "shown AS (SELECT *, CASE WHEN n > 0 AND total > 100 THEN total END AS now FROM sums), "
            "moves AS (SELECT *, lag(now) OVER (PARTITION BY l_orderkey ORDER BY place) AS before FROM shown) "
            "SELECT l_orderkey, epoch, CAST(-1 AS BIGINT) AS w, before AS sum_qty FROM moves "
            "WHERE before IS NOT NULL AND now IS DISTINCT FROM before UNION ALL "
            "SELECT l_orderkey, epoch, CAST(1 AS BIGINT), now FROM moves "
            "WHERE now IS NOT NULL AND now IS DISTINCT FROM before"
        ),
        "running_revenue": (
            f"WITH j AS ({joined_changes}) SELECT CAST(w AS BIGINT) AS w, epoch, c_custkey, {Q3_KEYS}, l_partkey, "
            f"l_extendedprice, l_discount, CAST(sum(CASE WHEN w > 0 THEN {REVENUE} * CAST(w AS DECIMAL(4,0)) ELSE 0 END) "
            f"OVER (PARTITION BY {Q3_KEYS} ORDER BY epoch, c_custkey, l_partkey, l_extendedprice, l_discount "
            "ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS revenue FROM j"
        ),
        "rolled_output": (
            "SELECT epoch || chr(9) || w || chr(9) || o_orderkey || chr(9) || o_custkey || chr(9) || o_orderstatus "
            f"|| chr(9) || o_orderpriority AS value FROM {logs['orders']}"
        ),
        "q18_batch": q18(*tables, 270),
        "q18_rewritten": q18(*tables, 300),
        "q18_by_epoch": " UNION ALL ".join(
            f"SELECT CAST({e} AS BIGINT) AS epoch, * FROM ({q18_at(e)})" for e in range(last + 1)
        ),
        "q18_by_epoch_orphans": " UNION ALL ".join(
            f"SELECT CAST({e} AS BIGINT) AS epoch, * FROM ({q18(*orphaned(e), bound)})" for e in range(last + 1)
        ),
        "q18_complete_epochs": " UNION ALL ".join(
            f"SELECT CAST({e} AS BIGINT) AS epoch, * FROM ({q18_at(e)})" for e in range(last + 1)
        ),
        "q18_stream_netted": q18_at(last),
        "q18_stream_having": q18_at(last),
        "q3_revenue": q3(*lives),
        "q3_revenue_orphans": q3(*orphaned(last)),
        "q3_filtered": q3(*tables, "WHERE c_mktsegment = 'AUTOMOBILE' AND o_orderdate < '1995-03-31'"),
        "q3_stream": q3(*lives),
        "q3_totals_stream": q3(*lives),
        "result_text": (
            "SELECT printf('(%s, %s, %s, %s, %.6f, %.6f)', c_name, CAST(c_custkey AS VARCHAR), "
            "CAST(o_orderkey AS VARCHAR), o_orderdate, o_totalprice, sum_qty) AS result "
            f"FROM ({q18(*tables, bound)})"
        ),
    }
    # Streams that keep up what a batch query gives.
    kept = {"delete_by_key": "delete_by_key_stream", "guard_customer": "guard_customer_stream",
            "running_quantity": "running_quantity_stream", "q18_stream_having": "q18_delta_join",
            "q3_revenue": "q3_live_tuples"}
    return found | {stream: found[batch] for batch, stream in kept.items()}
