"""Rolled files hold every line once, within their limits, over replays and lost rolls."""

import pytest
from pyspark.sql import functions as F

import tidemark.streaming.rolled as rolled
from tidemark.streaming.rolled import RolledOutput


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def shown(out, spark):
    return sorted(r[0] for r in out.read(spark).collect())


def test_rolls_by_size_within_the_limit(spark, folder):
    out = RolledOutput(folder, most_bytes=1000)
    given = [f"{n:05d}" + "x" * (n * 7 % 60) for n in range(200)] + ["same"] * 5 + ["L" * 300, "M" * 3000]
    out.step(lines(spark, *given[:10]), 0)
    assert shown(out, spark) == [] and out.manifest(spark).count() == 0
    for _ in range(2):
        out.step(lines(spark, *given[10:]).repartition(5), 1)
    assert shown(out, spark) == sorted(given)
    files = out.manifest(spark).collect()
    packed = [r for r in sorted(files, key=lambda r: r["bin"]) if r["bin"] >= 0]
    assert sorted(r["bytes"] for r in files if r["bin"] < 0) == [301, 3001]
    assert all(r["bytes"] <= 1000 for r in packed) and all(r["bytes"] >= 750 for r in packed[:-1])
    assert sum(r["bytes"] for r in files) == sum(len(v) + 1 for v in given)
    # A file each.
    assert len(spark.read.text(f"{folder}/parts/roll=0").inputFiles()) == len(files)


def test_rolls_by_age_and_idleness(spark, folder):
    clock = Clock()
    out = RolledOutput(folder, most_age=100, most_idle=30, clock=clock)
    out.step(lines(spark, "a", None), 0)
    clock.now = 29.0
    assert not out.roll(spark)
    clock.now = 31.0
    assert out.roll(spark) and shown(out, spark) == ["", "a"]
    for number, clock.now in enumerate((50.0, 75.0, 100.0, 125.0), 1):
        out.step(lines(spark, f"b{number}"), number)
        assert len(shown(out, spark)) == 2
    clock.now = 151.0
    assert out.roll(spark) and len(shown(out, spark)) == 6
    # Batches without lines, or none at all, are no reason for a file.
    out.step(lines(spark), 5)
    clock.now = 1000.0
    assert not out.roll(spark, now=True) and out.manifest(spark).count() == 2


@pytest.mark.parametrize("at", ["parts", "manifest"])
def test_a_lost_roll_is_done_once(spark, folder, monkeypatch, at):
    out = RolledOutput(folder, most_bytes=10)
    keep = rolled.publish

    def lost(df, where, *args, **kwargs):
        if where.endswith(at):
            raise OSError("lost")
        keep(df, where, *args, **kwargs)

    monkeypatch.setattr(rolled, "publish", lost)
    with pytest.raises(OSError):
        out.step(lines(spark, "first line", "second"), 0)
    assert shown(out, spark) == []
    monkeypatch.setattr(rolled, "publish", keep)
    out.step(lines(spark, "first line", "second"), 0)
    out.step(lines(spark, "third line"), 1)
    assert shown(out, spark) == ["first line", "second", "third line"]
