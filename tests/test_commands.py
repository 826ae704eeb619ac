"""The command line over a text log that grows between runs."""

from tidemark.__main__ import give, parser

C = "{}\t{}\tCustomer {}\tx\t5\tx\t1.00\tAUTOMOBILE\tx\tcustomer"
O = "{}\t{}\t{}\tO\t10.50\t{}\t3-MEDIUM\tx\t0\tx\torders"
L = "{}\t{}\t{}\t3\t7\t{}\t100.00\t0.10\t0.00\tN\tO\t7/6/1997\t7/6/1997\t7/6/1997\tx\tx\tx\tlineitem"


def test_a_result_is_given_whole(spark, tmp_path, capsys):
    result = spark.range(45).selectExpr("id", "cast(null AS string) AS none")
    give(result, parser().parse_args(["check", "log", "--to", str(tmp_path / "out")]))
    assert capsys.readouterr().out == ""
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 45
    give(result, parser().parse_args(["check", "log"]))
    assert sorted(capsys.readouterr().out.split("\n")) == sorted(["", "id\tnone", *[f"{k}\t" for k in range(45)]])


def run(spark, *words):
    args = parser().parse_args([str(w) for w in words])
    return args.run(spark, args)


def test_commands_over_a_growing_log(spark, tmp_path):
    source, log = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    (source / "0.txt").write_text("\n".join([
        C.format("+", 1, 1), C.format("+", 2, 2), O.format("+", 1, 1, "1/1/1995"), O.format("+", 2, 2, "1/1/1996"),
        L.format("+", 1, 1, 200), L.format("+", 1, 2, 101), L.format("+", 2, 1, 301), "Bye"]) + "\n")
    run(spark, "ingest", source, log)
    assert {(r.o_orderkey, int(r.sum_qty)) for r in run(spark, "q18", log, tmp_path / "q18").collect()} == {(1, 301), (2, 301)}
    assert {r.o_orderkey for r in run(spark, "q3", log, tmp_path / "q3", "--filtered").collect()} == {1}

    (source / "1.txt").write_text("\n".join([L.format("-", 1, 2, 101), C.format("-", 2, 2), "Bye", C.format("+", 2, 2), "End"]) + "\n")
    run(spark, "ingest", source, log)
    assert {r.o_orderkey for r in run(spark, "q18", log, tmp_path / "q18").collect()} == {2}
    assert {(r.o_orderkey, float(r.revenue)) for r in run(spark, "q3", log, tmp_path / "q3", "--filtered").collect()} == {(1, 90.0)}

    assert run(spark, "ingest", source, log).where("input_rows > 0").count() == 2
    by_epoch = {(r.epoch, r.o_orderkey) for r in run(spark, "check", log).collect()}
    assert by_epoch == {(0, 1), (0, 2), (2, 2)}
    for epoch in range(3):
        at = {(epoch, r.o_orderkey) for r in run(spark, "check", log, "--epoch", epoch).collect()}
        assert at == {x for x in by_epoch if x[0] == epoch}
