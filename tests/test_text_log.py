from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.session import settings
from tidemark.sources import table_log, text_log
from tidemark.streaming.ingest import ingest
from tidemark.streaming.runner import finish

CUSTOMER = "+\t10\tCustomer 10\tSome street\t5\t15-741\t2753.54\tHOUSEHOLD\tcareful\tcustomer"
ORDER = "+\t7\t10\tO\t258779.02\t4/4/1997\t3-MEDIUM\tClerk 1\t0\tpending\torders"
LINE = ("-\t7\t116\t3\t7\t18\t18289.98\t0.01\t0.00\tN\tO\t7/6/1997\t13/05/1997\t10/6/1997\t"
        "IN PERSON\tFOB\tregular\tlineitem")
NATION = "+\t3\tCANADA\t1\tfar\tnation"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def read(spark, path):
    return text_log.parse(text_log.read_lines(spark, str(path)))


def test_typed_rows_per_table(spark, tmp_path):
    write(tmp_path / "log.txt", CUSTOMER, ORDER, "Bye", LINE, NATION, "End")
    records = read(spark, tmp_path / "log.txt")
    order = text_log.table_changes(records, "orders").first()
    assert (order.w, order.epoch, order.seq) == (1, 0, 1)
    # A float would give 258779.015625.
    assert order.o_totalprice == Decimal("258779.02")
    assert order.o_orderdate == date(1997, 4, 4)
    line = text_log.table_changes(records, "lineitem").first()
    assert (line.w, line.epoch, line.l_quantity, line.l_commitdate) == (-1, 1, Decimal("18.00"), date(1997, 5, 13))
    assert text_log.table_changes(records, "nation").first().n_name == "CANADA"
    assert text_log.table_changes(records, "customer").count() == 1
    assert text_log.quarantine(records).isEmpty()


def test_trailing_tabs_are_no_fields(spark, tmp_path):
    write(tmp_path / "log.txt", ORDER + "\t", ORDER + "\t\t")
    records = read(spark, tmp_path / "log.txt")
    assert text_log.table_changes(records, "orders").count() == 2


def test_empty_inner_fields_are_empty_text(spark, tmp_path):
    write(tmp_path / "log.txt", CUSTOMER.replace("careful", ""))
    customer = text_log.table_changes(read(spark, tmp_path / "log.txt"), "customer").first()
    assert customer.c_comment == ""


BAD = {
    "unknown table": ORDER.replace("orders", "order"),
    "field count": CUSTOMER.replace("\tcareful", ""),
    "change flag": "*" + ORDER[1:],
    "bad value": ORDER.replace("4/4/1997", "31/2/1997"),
}


def test_bad_records_say_why(spark, tmp_path):
    write(tmp_path / "log.txt", *BAD.values(), ORDER.replace("\t7\t", "\tx\t", 1), "", ORDER)
    records = read(spark, tmp_path / "log.txt")
    found = [(r.seq, r.reason) for r in text_log.quarantine(records).orderBy("seq").collect()]
    assert found == [*enumerate(BAD), (4, "bad value"), (5, "unknown table")]
    assert text_log.table_changes(records, "orders").count() == 1


def test_unknown_table_policies(spark, tmp_path):
    write(tmp_path / "log.txt", BAD["unknown table"], BAD["change flag"])
    records = read(spark, tmp_path / "log.txt")
    assert text_log.quarantine(records, "drop").count() == 1
    with pytest.raises(Exception, match="unknown table: order"):
        text_log.quarantine(records, "fail").collect()
    for taken in (text_log.table_changes(records, "orders", "fail"), text_log.routed(records, "fail")):
        with pytest.raises(Exception, match="unknown table: order"):
            taken.collect()
    assert text_log.routed(records, "drop").count() == 1
    with pytest.raises(ValueError):
        text_log.quarantine(records, "ignore")


def expected(lines):
    """Line number and epoch of each data line, one after the other."""
    epoch, found = 0, []
    for seq, line in enumerate(lines):
        if line == "Bye":
            epoch += 1
        elif line != "End":
            found.append((epoch, seq, line))
    return found


@pytest.mark.parametrize("split", ["37", "1000", "100000000"])
def test_epochs_do_not_depend_on_how_files_are_split(spark, tmp_path, split):
    first = [f"line {i}" for i in range(40)] + ["Bye"] + ["x" * 90] + ["Bye", "Bye"]
    second = ["Bye"] + [f"more {i}" for i in range(25)] + ["Bye", "last", "End"]
    write(tmp_path / "log" / "a.txt", *first)
    write(tmp_path / "log" / "b.txt", *second)
    options = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    with settings(spark, options):
        rows = text_log.read_lines(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == expected(first + second)


def test_a_changed_split_size_is_noticed(spark, tmp_path):
    write(tmp_path / "log.txt", *[f"line {i}" for i in range(50)])
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "1"}):
        lines = text_log.read_lines(spark, str(tmp_path / "log.txt"))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "100"}):
        with pytest.raises(Exception, match="split size"):
            lines.select("*").collect()


def test_many_markers_in_one_split(spark, tmp_path):
    """A split with a hundred thousand epochs: no list of markers grows beyond its bucket of lines."""
    lines = [line for k in range(100_000) for line in (f"line {k}", "Bye")]
    write(tmp_path / "log.txt", *lines)
    raw = text_log.with_position(spark.read.text(str(tmp_path / "log.txt")))
    assert text_log.summarize_splits(raw).agg(F.max(F.size("marks"))).first()[0] <= 1 << text_log.BUCKET_BITS
    rows = text_log.read_lines(spark, str(tmp_path / "log.txt"))
    assert rows.where("epoch * 2 = seq AND value = concat('line ', epoch)").count() == 100_000


def test_epoch_folders(spark, tmp_path):
    write(tmp_path / "log" / "epoch=0" / "a.txt", ORDER)
    write(tmp_path / "log" / "epoch=1" / "a.txt", LINE, "End")
    lines = text_log.read_epoch_folders(spark, str(tmp_path / "log"))
    assert {(r.epoch, r.tag) for r in text_log.parse(lines).collect()} == {(0, "orders"), (1, "lineitem")}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = text_log.parse(text_log.stream_epoch_folders(spark, str(tmp_path / "log"), files_per_batch=1))
    stream = text_log.table_changes(stream, "orders")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_written_text_reads_back(spark, folder):
    log = spark.sql("SELECT 1 AS w, 0 AS epoch, 5L AS o_orderkey, 6L AS o_custkey, 'F' AS o_orderstatus, "
                    "12.5 AS o_totalprice, DATE'1997-04-09' AS o_orderdate, '1-URGENT' AS o_orderpriority")
    text_log.write_marked(text_log.to_lines(log, "orders"), folder, 0)
    text_log.write_marked(text_log.to_lines(log.withColumn("w", F.lit(-1)), "orders"), folder, 1)
    rows = text_log.table_changes(read(spark, folder), "orders").orderBy("seq").collect()
    assert [(r.w, r.epoch, r.o_orderkey, r.o_totalprice, r.o_orderdate) for r in rows] == [
        (1, 0, 5, Decimal("12.50"), date(1997, 4, 9)), (-1, 1, 5, Decimal("12.50"), date(1997, 4, 9))]


def test_stream_takes_epochs_on_from_batch_to_batch(spark, tmp_path):
    """A log that comes in three files, the stream being restarted after the first."""
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    files = [[ORDER, CUSTOMER], ["Bye", LINE, BAD["change flag"]], ["Bye", ORDER.replace("+", "-"), "End"]]
    for i, lines in enumerate(files):
        write(source / f"{i}.txt", *lines)
        finish(ingest(spark, str(source), target, checkpoint))
    orders = table_log.read_routed(spark, target, "orders").orderBy("seq").collect()
    assert [(r.w, r.epoch, r.seq) for r in orders] == [(1, 0, 0), (-1, 2, 6)]
    assert table_log.read_routed(spark, target, "lineitem").first().epoch == 1
    assert table_log.read_routed(spark, target, "quarantine").first().reason == "change flag"
