"""Command line: take in a text log, keep a query up to date, check it in batch.

    python -m tidemark ingest SOURCE LOG     text log with epoch markers to parquet
    python -m tidemark q18 LOG OUT           Q18 as a stream over the log so far
    python -m tidemark q3 LOG OUT            Q3 as a stream over the log so far
    python -m tidemark check LOG             Q18 in batch at the end of each epoch

Each run takes up what has come in since the last one.  The whole result is
printed, or with --to written to a folder as CSV; --rows N shows N rows only.
"""

import argparse

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.zset import as_rows, last_epoch, snapshot
from tidemark.plans import q3, q18
from tidemark.session import prepare
from tidemark.sources.table_log import read_routed, stream_routed
from tidemark.streaming.ingest import ingest
from tidemark.streaming.runner import Timings, epoch_timings, finish, print_rows

TAGS = ("customer", "orders", "lineitem")


def run_ingest(spark: SparkSession, args) -> DataFrame:
    timings = f"{args.log}/_timings"
    listener = Timings(spark, timings, "ingest")
    spark.streams.addListener(listener)
    finish(ingest(spark, args.source, args.log, f"{args.log}/_checkpoint", args.files, on_unknown=args.unknown,
                  state_partitions=args.state_partitions))
    # The last batch's report may come in after its end.
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    return epoch_timings(spark, timings)


def _streams(spark: SparkSession, args) -> list[DataFrame]:
    return [stream_routed(spark, args.log, tag, args.files) for tag in TAGS]


def run_q18(spark: SparkSession, args) -> DataFrame:
    customer, orders, lineitem = _streams(spark, args)
    out, parts = args.out, args.state_partitions
    finish(q18.start_large(lineitem, f"{out}/large", f"{out}/checkpoint-large", args.bound, available_now=True,
                           state_partitions=parts))
    large = q18.stream_large(spark, f"{out}/large")
    finish(q18.start_picked(customer, orders, large, f"{out}/changes", f"{out}/checkpoint-picked", available_now=True,
                            state_partitions=parts))
    return q18.read_picked(spark, f"{out}/changes")


def run_q3(spark: SparkSession, args) -> DataFrame:
    customer, orders, lineitem = _streams(spark, args)
    if args.filtered:
        customer, orders = q3.filtered(customer, orders)
    out, parts = args.out, args.state_partitions
    finish(q3.start_sums(lineitem, f"{out}/sums", f"{out}/checkpoint-sums", available_now=True, state_partitions=parts))
    finish(q3.start_joined(customer, orders, q3.stream_sums(spark, f"{out}/sums"), f"{out}/changes", f"{out}/checkpoint",
                           available_now=True, state_partitions=parts))
    return q3.read_joined(spark, f"{out}/changes")


def run_check(spark: SparkSession, args) -> DataFrame:
    logs = [read_routed(spark, args.log, tag).drop("seq") for tag in TAGS]
    if args.epoch is not None:
        return q18.batch(*[as_rows(snapshot(log, args.epoch)) for log in logs], bound=args.bound)
    return q18.by_epoch(*logs, last=last_epoch(*logs), bound=args.bound)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(required=True)

    def command(name, run, *places):
        sub = commands.add_parser(name)
        for place in places:
            sub.add_argument(place)
        sub.add_argument("--to", help="folder to write the whole result to, as CSV")
        sub.add_argument("--rows", type=int, help="show only so many rows")
        sub.add_argument("--files", type=int, help="most files in a batch")
        sub.add_argument("--state-partitions", type=int, help="of new checkpoints; else one per local core, or the shuffle partitions of a cluster's session")
        sub.set_defaults(run=run)
        return sub

    ingested = command("ingest", run_ingest, "source", "log")
    ingested.add_argument("--unknown", default="quarantine", choices=("quarantine", "drop", "fail"),
                          help="what to do with records of an unknown table")
    command("q18", run_q18, "log", "out").add_argument("--bound", type=float, default=q18.BOUND)
    command("q3", run_q3, "log", "out").add_argument("--filtered", action="store_true")
    check = command("check", run_check, "log")
    check.add_argument("--bound", type=float, default=q18.BOUND)
    check.add_argument("--epoch", type=int)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = prepare(SparkSession.builder.appName("tidemark").getOrCreate())
    give(args.run(spark, args), args)


def give(result: DataFrame, args) -> None:
    """Write or print the whole result, or show some of it if asked."""
    if args.to:
        result.write.mode("overwrite").option("header", True).csv(args.to)
    if args.rows is not None:
        result.show(args.rows, truncate=False)
    elif not args.to:
        print("\t".join(result.columns))
        print_rows(result)


if __name__ == "__main__":
    main()
