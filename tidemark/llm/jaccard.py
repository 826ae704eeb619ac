"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set is its distinct shingles; documents with equal sets are one.
Two sets of Jaccard similarity t or more must share a shingle among the first
n - ceil(t n) + 1 of each, under any global order of all shingles.  All orders
here put frequent shingles last, by their count over all documents, and differ in
how they deal the rest.  A candidate must share prefix shingles under each:

1. Shingles are counted by the leading bits of their hash, packed two bytes each.
   A bit table of fixed size tells which may occur more than once; the others come
   first in every order and are never posted, as nothing can share them.  The most
   frequent (at most LISTED, each in 8 documents or more) have their counts broadcast
   too and come last by these.
2. Prefixes under the first order are joined on the shingle, with bounds on the
   sizes and on the shingle's place in either set: all that comes before it there is
   not shared.  A first round links each set only to one hub per shingle, the most
   central set; sets that came to lie in one component need no further comparing, so
   large groups of near copies cost no pairs.  The last round takes all pairs left that
   lie in different components.
3. A pair's prefixes under the other orders, kept with the sets, must meet too;
   only then are the whole sets compared.

Only links inside a component are left out, so components are exact.

Cases: a document without words or text (null, empty) has an empty set and links
with nothing; one with fewer words than a shingle is one shingle; equal texts and
repeated rows share a class; a null doc_id links, but names no component; an
empty table gives no rows; other columns are ignored.  Sets are told apart by a
64-bit digest and their size.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.files import Scratch
from tidemark.llm.words import LOWER, NOT_SPACE, Words, grams, mix, pieces
from tidemark.session import written

#: Most shingles whose count is broadcast, and the least count they may have.
LISTED, FREQUENT = 1_000_000, 8
#: Bits of the table of shingles that may occur more than once: 8 MB.  Fuller tables only spare less.
SHARED_BITS = 26
#: Seeds of the orders; the first makes the candidates.
ORDERS = (0x51A3, 0x7F4B, 0x2C19)
#: Rounds in which each shingle has one hub.
HUB_ROUNDS = 1
#: Bits of the table that tells which documents take part in candidates.
FILTER_BITS = 1 << 26
#: What the two sides of a pair need, and the letter before x or y that names it.
COLUMNS = {"set_id": "", "n": "n", "place": "p"}
_FLUSH = 4_000_000
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Shingles of `size` words; a link from `percent` of the union on."""

    size: int = 5
    percent: int = 80

    def prefix(self, n):
        return n + 1 + (-self.percent * n) // 100

    def may_link(self, x: str, y: str):
        """Whether sets of nx and ny shingles whose first common one has the places px and py may be similar."""
        nx, ny, px, py = [F.col(f"{c}{side}") for c in "np" for side in (x, y)]
        common = F.least(nx - px, ny - py)
        return (100 + self.percent) * common >= self.percent * (nx + ny)


class Sets:
    """The shingle sets of a piece of documents: `tokens` sorted by document, then hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        words = Words(LOWER[data], offsets, NOT_SPACE)
        hashes, position = grams(words, size, whole=True)
        text = words.text[position]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.tokens, self.text = hashes[first], text[first]
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        self.n = np.diff(self.first)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.tokens) + 1, _U)
            np.cumsum(mix(self.tokens), out=sums[1:])
            self.ids = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(_U)).view(np.int64)

    def prefixes(self, frequent: "Frequent", seed: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """All prefix tokens under one order, document by document, and their places in it."""
        order = np.lexsort((mix(self.tokens ^ _U(seed)), frequent.counts(self.tokens), self.text))
        rank = np.arange(len(order)) - self.first[self.text[order]]
        inside = rank < rule.prefix(self.n)[self.text[order]]
        return order[inside], rank[inside]


class Frequent:
    """The counts of the listed shingles; 1 for others that may be shared, 0 for those that are not."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n, self.bits = keys[order].astype(np.uint32), counts[order].astype(np.int64), bits

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        bit = (tokens >> _U(64 - SHARED_BITS)).astype(np.int64)
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        known = self.shared(tokens).astype(np.int64)
        if len(self.keys):
            at = np.flatnonzero(known)
            keys = (tokens[at] >> _U(32)).astype(np.uint32)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known[at] = np.where(self.keys[place] == keys, self.n[place], 1)
        return known


# --- counting ---------------------------------------------------------------


def _surveyed(documents: DataFrame, rule: Rule, parts_bits: int) -> DataFrame:
    """Two kinds of rows: each document's set (part -1), and packed shingle keys by part.

    A key is a hash's first 32 bits: the high 16 as counts per value, the low 16 as they are.
    """
    span = 1 << (16 - parts_bits)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        high = np.bincount(keys >> 16, minlength=1 << 16).astype("<u4").reshape(-1, span)
        low, ends = (keys & 0xFFFF).astype("<u2"), np.cumsum(high.sum(1))
        blobs = [h.tobytes() + low[e - h.sum():e].tobytes() for h, e in zip(high, ends)]
        none = pa.nulls(len(blobs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(blobs)), pa.int32()), none, none, none, pa.array(blobs)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for rows, data, offsets in pieces(batches, "text"):
            sets = Sets(data, offsets, rule.size)
            held.append((sets.tokens >> _U(32)).astype(np.uint32))
            many += len(sets.tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sets.n), -1), pa.int32()), rows.column(0), pa.array(sets.ids), pa.array(sets.n),
                 pa.nulls(len(sets.n), pa.binary())], schema=schema)
            if many >= _FLUSH:
                yield packed(held)
                held, many = [], 0
        if many:
            yield packed(held)

    return documents.mapInArrow(run, "part int, doc_id bigint, set_id bigint, n bigint, keys binary")


def _counted(packed: DataFrame, parts_bits: int) -> DataFrame:
    """key, n of the shingle keys that occur FREQUENT times or more; and by part, the bits of all that occur twice."""
    span = 1 << (16 - parts_bits)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        found = []
        for blob in table.column("keys").to_pylist():
            high = np.frombuffer(blob, "<u4", span)
            low = np.frombuffer(blob, "<u2", offset=4 * span).astype(np.uint32)
            found.append((np.repeat(np.arange(span, dtype=np.uint32), high) << np.uint32(16)) | low)
        keys = np.sort(np.concatenate(found))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(starts, len(keys)))
        often = n >= FREQUENT
        base = key[0].as_py() * span << 16
        shared = np.zeros(span << (SHARED_BITS - 16), bool)
        shared[keys[starts[n > 1]] >> np.uint32(32 - SHARED_BITS)] = True
        bits = np.packbits(shared, bitorder="little").tobytes()
        return pa.table({
            "key": pa.array(np.append(keys[starts[often]].astype(np.int64) + base, base)),
            "n": pa.array(np.append(n[often], 0)),
            "bits": pa.array([None] * int(often.sum()) + [bits], pa.binary()),
        })

    return packed.groupBy("part").applyInArrow(count, "key bigint, n bigint, bits binary")


def _frequent(counted: DataFrame) -> Frequent:
    """The most frequent keys, at most LISTED, and the whole bit table."""
    bits = np.zeros(1 << (SHARED_BITS - 3), np.uint8)
    for row in counted.where("bits IS NOT NULL").select("key", "bits").toLocalIterator():
        at = row["key"] >> (32 - SHARED_BITS + 3)
        bits[at:at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    listable = counted.where("bits IS NULL").select("key", "n")
    sizes = listable.groupBy("n").count().orderBy(F.desc("n")).collect()
    least, listed = None, 0
    for row in sizes:
        listed += row["count"]
        if listed > LISTED:
            break
        least = row["n"]
    if least is None:
        return Frequent(np.zeros(0, np.int64), np.zeros(0, np.int64), bits)
    table = listable.where(F.col("n") >= least).toArrow()
    return Frequent(table["key"].to_numpy(), table["n"].to_numpy(), bits)


# --- candidates -------------------------------------------------------------


def _posted(documents: DataFrame, rule: Rule, shared) -> DataFrame:
    """token, set_id, n, place, alone: what may be shared of each set's prefix under the first order.

    `alone` counts the shingles that no other set has.  A task gives a set once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for _, data, offsets in pieces(batches, "text"):
            sets = Sets(data, offsets, rule.size)
            _, once = np.unique(sets.ids, return_index=True)
            fresh = np.zeros(len(sets.n), bool)
            fresh[once] = ~np.isin(sets.ids[once], seen)
            seen = np.union1d(seen, sets.ids)
            known = shared.value.shared(sets.tokens)
            alone = sets.n - np.bincount(sets.text[known], minlength=len(sets.n))
            at, place = sets.prefixes(shared.value, ORDERS[0], rule)
            kept = fresh[sets.text[at]] & known[at]
            at, place = at[kept], place[kept]
            text = sets.text[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.tokens[at].view(np.int64)), *[pa.array(c) for c in (sets.ids[text], sets.n[text], place, alone[text])]],
                ["token", "set_id", "n", "place", "alone"])

    return documents.select("text").mapInArrow(run, "token bigint, set_id bigint, n bigint, place bigint, alone bigint")


def _live(posted: DataFrame) -> DataFrame:
    """The postings of tokens that more than one set has."""
    shared = posted.groupBy("token").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
    return posted.join(shared.select("token"), "token").distinct()


def _bit(name: str):
    return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))


def _member_bits(documents: DataFrame, name: str = "doc_id"):
    """Documents as bits of a table of fixed size; others may share a bit, none is missed."""
    placed = documents.select(_bit(name).alias("bit"))
    words = placed.groupBy(F.shiftright("bit", 5).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit % 32 AS INT)))").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return documents.sparkSession.sparkContext.broadcast(table)


def _kept_sets(documents: DataFrame, rule: Rule, shared, bits) -> DataFrame:
    """The whole sets of documents whose bit is set, with their prefixes under the other orders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            for _, data, offsets in pieces(iter([batch]), "text"):
                sets = Sets(data, offsets, rule.size)
                others = []
                for seed in ORDERS[1:]:
                    place, _ = sets.prefixes(shared.value, seed, rule)
                    cut = np.searchsorted(sets.text[place], np.arange(len(sets.n) + 1))
                    # Half a hash: prefixes only tell which pairs are compared.
                    tokens = (sets.tokens[place] >> _U(32)).astype(np.uint32)
                    others.append([np.sort(tokens[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])])
                tokens = [sets.tokens[a:b].tobytes() for a, b in zip(sets.first[:-1], sets.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.ids), pa.array(tokens), pa.array([list(x) for x in zip(*others)], pa.list_(pa.binary()))],
                    ["set_id", "tokens", "prefixes"])

    numbered = documents.select("doc_id", "text", _bit("doc_id").alias("bit"))
    return numbered.mapInArrow(run, "set_id bigint, tokens binary, prefixes array<binary>")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are similar: by the filters of the other orders, then exactly."""
    def common(a: bytes, b: bytes, kind: type) -> int:
        x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
        if len(x) > len(y):
            x, y = y, x
        place = np.searchsorted(y, x)
        place[place == len(y)] = 0
        return int((y[place] == x).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b = batch.column(3)[k].as_py(), batch.column(5)[k].as_py()
                if all(common(x, y, np.uint32) for x, y in zip(a, b)):
                    x, y = batch.column(2)[k].as_py(), batch.column(4)[k].as_py()
                    both = common(x, y, _U)
                    keep.append(100 * both >= rule.percent * ((len(x) + len(y)) // 8 - both))
                else:
                    keep.append(False)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), F.col("tokens").alias(f"{name}_tokens"),
                           F.col("prefixes").alias(f"{name}_prefixes"))

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "a_tokens", "a_prefixes", "b_tokens", "b_prefixes").mapInArrow(run, "a bigint, b bigint")


def _linked(live: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(node, root) of the sets that have a link."""
    spark = live.sparkSession
    links = spark.createDataFrame([], "a bigint, b bigint")
    roots = None
    for round_number in range(HUB_ROUNDS + 1):
        own = live.withColumn("root", F.col("set_id")) if roots is None else (
            live.join(roots, F.col("set_id") == F.col("node"), "left")
            .select(*live.columns, F.coalesce("root", "set_id").alias("root")))
        # First the set with the smallest share of shingles of its own, then any.
        central = F.col("alone") / F.col("n") if round_number == 0 else F.lit(0.0)
        # Tokens whose sets all lie in one component are done.
        split = own.groupBy("token").agg(
            F.min("root").alias("low"), F.max("root").alias("high"),
            F.min(F.struct(central.alias("c"), F.xxhash64("set_id", F.lit(round_number)).alias("h"),
                           "set_id", "n", "place", "root")).alias("hub"),
        ).where("low < high").select("token", "hub")
        if round_number < HUB_ROUNDS:
            pairs = own.join(split, "token").where("root <> hub.root").select(
                *[F.col(c).alias(f"{s}x") for c, s in COLUMNS.items()], *[F.col(f"hub.{c}").alias(f"{s}y") for c, s in COLUMNS.items()])
        else:
            rest = scratch.written(own.join(split.select("token"), "token"), "rest")
            left = rest.select("token", F.col("root").alias("rx"), *[F.col(c).alias(f"{s}x") for c, s in COLUMNS.items()])
            right = rest.select("token", F.col("root").alias("ry"), *[F.col(c).alias(f"{s}y") for c, s in COLUMNS.items()])
            pairs = left.join(right, "token").where("x < y AND rx <> ry")
        pairs = pairs.where(rule.may_link("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = scratch.written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = scratch.written(_verified(pairs, sets, rule), "links")
        scratch.drop(pairs)
        if not found.isEmpty():
            links = links.union(found)
            roots = scratch.written(components(links), "roots")
    return components(links) if roots is None else roots


def classes(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document."""
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    parts_bits = min(14, max(6, (2 * documents.rdd.getNumPartitions()).bit_length()))
    scratch = Scratch(documents.sparkSession)
    surveyed = scratch.written(_surveyed(documents, rule, parts_bits), "surveyed")
    sets_of = scratch.written(surveyed.where("part = -1").select("doc_id", "set_id", "n"), "sets-of")
    counted = scratch.written(_counted(surveyed.where("part >= 0").select("part", "keys"), parts_bits), "counted")
    shared = documents.sparkSession.sparkContext.broadcast(_frequent(counted))
    scratch.drop(surveyed, counted)
    posted = scratch.written(_posted(documents, rule, shared), "posted")
    live = scratch.written(_live(posted), "live")
    scratch.drop(posted)
    taking_part = live.select("set_id").distinct()
    first_of = sets_of.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    bits = _member_bits(first_of.join(taking_part, "set_id"))
    kept = _kept_sets(documents, rule, shared, bits).join(first_of.join(taking_part, "set_id").select("set_id"), "set_id", "left_semi")
    sets = scratch.written(kept.dropDuplicates(["set_id"]), "sets")
    # What the broadcasts were for is in tables now.
    shared.destroy()
    bits.destroy()
    roots = _linked(live, sets, rule, scratch)
    rooted = sets_of.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "set_id")).alias("root"))
    rooted = written(rooted, "rooted")
    scratch.drop_all()
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """`documents` with one row of each group of rows that are linked, directly or over others.

    It is the row of the smallest doc_id, null last, then of the smallest md5 of
    the text; of rows with the same doc_id and text, any.  Rows are told apart
    whatever their doc_id, and those without words are linked to none.
    """
    row = "row_number"
    while row in [c.lower() for c in documents.columns]:
        row += "_"
    numbered = written(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = written(classes(numbered.select(F.col(row).alias("doc_id"), "text"), rule).select(
        F.col("doc_id").alias(row), "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.md5("text").alias("digest"), row)
    keep = numbered.select(row, order.alias("own")).join(groups, row).groupBy("component_id").agg(F.min("own").alias("own"))
    away = groups.select(row).join(keep.select(F.col(f"own.{row}").alias(row)), row, "left_anti")
    away = written(away, "away")
    bits = _member_bits(away, row)

    @F.arrow_udf("boolean")
    def marked(bit: pa.Array) -> pa.Array:
        at, table = bit.to_numpy(), bits.value
        return pa.array((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    # Only texts that may go are dealt out to be joined; all others stay where they are.
    doubtful = marked(_bit(row))
    rest = numbered.where(doubtful).join(away, row, "left_anti")
    return numbered.where(~doubtful).select(*documents.columns).unionByName(rest.select(*documents.columns))
