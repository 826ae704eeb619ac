"""Sharding by a k-d tree over the documents' metadata.

Documents with equal texts are one point, as heavy as all its copies, so copies
come to lie in one shard.  A node that is to give k shards is split where the
weight reaches k//2 of k parts, along the dimension in which its points spread
widest, until each leaf is one shard of the target bytes (`total / shards`).  Law: ``bytes``.

The medians are found for all nodes of a level at once by radix descent: the
points' order along a dimension is a 44-bit key (place in the dimension, then a
hash that breaks ties), and each step sums weights by the key's next 12 bits, so
the driver sees at most nodes x 4096 sums.  No sort, no sample.

Cases: a null text weighs as an empty one and shares its point; an empty table
gives no rows; a point heavier than the target makes its shard as heavy as it
is; with fewer points than shards some shards stay empty; null metadata count as
empty; rows that repeat are kept and get slots of their own.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import written

#: Bytes a document takes besides its text.
OVERHEAD = 16
#: A key has 12 bits of place and 32 of hash.
_BITS, _STEP = 44, 12
#: Median search ends where the bin left holds less than this part of a shard.
_FINE = 1 / 500


@dataclass
class Node:
    """A part of space that is to give the shards first to first + shards - 1."""

    number: int
    first: int
    shards: int


def points(documents: DataFrame) -> DataFrame:
    """One row per distinct text: its digest `point`, weight `w`, and the dimensions d0.. as 12-bit places."""
    text = F.coalesce("text", F.lit(""))
    return (
        documents.select(
            F.md5(text).alias("point"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            _place(F.coalesce("lang", F.lit(""))).alias("d0"),
            _place(F.coalesce("source", F.lit(""))).alias("d1"),
            # Lengths spread over many scales.
            (F.log2(F.octet_length(text) + F.lit(1.0)) * 64).cast("long").alias("d2"),
        )
        .groupBy("point")
        .agg(F.sum("size").alias("w"), F.min("d0").alias("d0"), F.min("d1").alias("d1"), F.min("d2").alias("d2"))
        .withColumn("node", F.lit(0))
        .withColumn("tie", F.conv(F.substring("point", 1, 8), 16, 10).cast("long"))
    )


def _place(label: Column) -> Column:
    """A label's place along its dimension."""
    return F.shiftright(F.crc32(label), 20)


DIMENSIONS = ("d0", "d1", "d2")


def assign(documents: DataFrame, shards: int) -> DataFrame:
    """point, w, shard: the shard of each distinct text."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    placed = written(points(documents), "points")
    leaves = {0: Node(0, 0, shards)}
    spans, target, count = None, 0.0, 1
    while open_nodes := {k: n for k, n in leaves.items() if n.shards > 1}:
        current = placed.where(F.col("node").isin(list(open_nodes)))
        boxes = current.groupBy("node").agg(
            F.sum("w").alias("w"), *[F.struct(F.min(d), F.max(d)).alias(d) for d in DIMENSIONS]).collect()
        if spans is None:
            spans = {d: max(1, *[r[d][1] - r[d][0] for r in boxes]) if boxes else 1 for d in DIMENSIONS}
            target = sum(r["w"] for r in boxes) / shards
        wide = {r["node"]: max(DIMENSIONS, key=lambda d: (r[d][1] - r[d][0]) / spans[d]) for r in boxes}
        left_weights = {r["node"]: r["w"] * (leaves[r["node"]].shards // 2) / leaves[r["node"]].shards for r in boxes}
        bounds = _medians(current, wide, left_weights, target)
        move = F.col("node")
        for number, node in open_nodes.items():
            half = node.shards // 2
            left = Node(count, node.first, half)
            right = Node(count + 1, node.first + half, node.shards - half)
            count += 2
            del leaves[number]
            leaves[left.number], leaves[right.number] = left, right
            if number in bounds:
                side = F.when(_key(wide[number]) < bounds[number], left.number).otherwise(right.number)
                move = F.when(F.col("node") == number, side).otherwise(move)
        # A table for each level keeps plans short.
        placed = written(placed.withColumn("node", move), "points")
    shard = F.create_map(*[F.lit(x) for n in leaves.values() for x in (n.number, n.first)])
    return placed.select("point", "w", shard[F.col("node")].alias("shard"))


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), 32).bitwiseOR(F.col("tie"))


def _medians(current: DataFrame, wide: dict[int, str], left: dict[int, float], target: float) -> dict[int, int]:
    """The key at which the weight of each node's points reaches `left`."""
    key = F.lit(None).cast("long")
    for number, dimension in wide.items():
        key = F.when(F.col("node") == number, _key(dimension)).otherwise(key)
    keyed = current.select("node", "w", key.alias("key"))
    # What is still to reach within the bin that each search has come to.
    rest, prefix, found, shift = dict(left), {n: 0 for n in wide}, {}, _BITS
    while rest:
        step = min(_STEP, shift)
        inside = F.lit(False)
        for n in rest:
            inside = inside | ((F.col("node") == n) & (F.shiftright("key", shift) == prefix[n]))
        shift -= step
        bins = {}
        for r in keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("w").alias("w")).collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for n in list(rest):
            for place, w in sorted(bins[n]):
                if rest[n] <= w:
                    break
                rest[n] -= w
            prefix[n] = place
            if w <= target * _FINE or shift == 0:
                # The bin goes where it leaves the smaller error.
                found[n] = (place + (rest[n] > w / 2)) << shift
                del rest[n]
    return found


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in each shard, in doc_id order)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("point"),
    )
    placed = rows.join(assign(documents, shards).select("point", "shard"), "point").drop("point")
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """`placed` with each row's place in its shard, by prefix sums over sorted partitions."""
    ordered = (
        placed.repartitionByRange(F.col("shard"), F.col("doc_id"), F.col("text_crc32"))
        .sortWithinPartitions("shard", "doc_id", "text_crc32")
        .withColumn("at", F.monotonically_increasing_id())
    )
    ordered = written(ordered, "sorted")
    # `at` counts on from a base of each partition; rows of a shard lie together in it.
    runs = ordered.groupBy("shard", F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("base"), F.count("*").alias("n"))
    before = F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    # A row for each partition and shard that meet: at most partitions + shards.
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    return (
        ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(runs), ["shard", "part"])
        .withColumn("slot", F.col("before") + F.col("at") - F.col("base"))
        .drop("at", "part", "base", "n", "before")
    )
