"""Ranked lexical search: exact best documents by sums of term impacts, LEMP style.

A document's vector has, for each term of the items that it holds, the coordinate
sqrt(w) * x, where w is the term's weight and x its impact in the document; an
item's vector has sqrt(w) for its terms.  The product of the two is the score.

Vectors are put in order by length, longest first, and cut into buckets of at most
BUCKET.  For each item a bucket is

1. left out if its longest vector's length times the item's is below the item's
   threshold (Cauchy-Schwarz), and so are all after it;
2. else filtered by coordinates: the item's FOCUS heaviest terms are added up, and
   what the rest may add is at most the product of the two remaining lengths;
3. what survives is scored in 64-bit integers.

An item's threshold is the score of the last of the best `most` known so far; it only
ever rules out what is below it, so the result is exact, with ties by doc_id.  The
longest vectors are searched first, and their thresholds go out with the search
of the others, whose files Spark skips by the stored length where no item can want
them.

Items go in blocks of some BLOCK_BYTES of distinct texts, a pass over the texts each:
what is broadcast (terms, weights, thresholds) is of a block's size.  The documents'
order is a range partition by length, with a row number behind it, so copies do not
gather in one task.  Terms are told apart by 64-bit hashes of their bytes.

Cases: null and empty texts have no terms and are found by none; an item without
terms, or whose terms no document holds, has no rows; items of equal text have the
same documents, each under its own item_id, null too; repeated documents are ranked
each, a null doc_id after all others of its score; other columns are ignored;
without documents or items there are no rows.
"""

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.words import ALNUM, LOWER, Words, pieces
from tidemark.session import written

MOST = 50
#: Vectors of a bucket, coordinates of a bucket of several, and terms that filter.
BUCKET, COORDINATES, FOCUS = 4096, 1 << 20, 6
#: Text of the items that are searched together.
BLOCK_BYTES = 4 << 20
#: Vectors that a search for first thresholds reads, or more if they are equally long.
SEED = 4096
#: Text that goes through numpy together.
PIECE = 1 << 20
#: Bounds are in doubles; they are widened by this much before they rule out.
SLACK = 1 + 1e-9
_U = np.uint64


# --- terms ------------------------------------------------------------------


@dataclass
class Items:
    """A block of items: the terms of all (sorted hashes), and each item's places among them."""

    texts: list[str]
    terms: np.ndarray
    held: list[np.ndarray]
    # Per term, once counted.
    weights: np.ndarray | None = None


def _items(texts: list[str]) -> Items:
    column = pa.array(texts, pa.large_string())
    held = []
    for rows, data, offsets in pieces([pa.RecordBatch.from_arrays([column], ["text"])], "text", BLOCK_BYTES):
        words = Words(LOWER[data], offsets, ALNUM)
        held += [np.unique(words.hashes[words.first[k]:words.first[k + 1]]) for k in range(rows.num_rows)]
    terms = np.unique(np.concatenate(held)) if held else np.zeros(0, _U)
    return Items(texts, terms, [np.searchsorted(terms, h) for h in held])


def term_counts(documents: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, n (terms with repeats), and the items' terms that the document holds: places and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for rows, data, offsets in pieces(batches, "text", PIECE):
            words = Words(LOWER[data], offsets, ALNUM)
            place = np.minimum(np.searchsorted(terms, words.hashes), max(0, len(terms) - 1))
            ours = np.flatnonzero(terms[place] == words.hashes) if len(terms) else np.zeros(0, np.int64)
            # A document's occurrences of a term, counted: both in one number, in order.
            found, counts = np.unique(words.text[ours] * max(1, len(terms)) + place[ours], return_counts=True)
            text, term = np.divmod(found, max(1, len(terms)))
            begin = pa.array(np.searchsorted(text, np.arange(len(offsets))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words.counts.astype(np.int64)),
                 pa.ListArray.from_arrays(begin, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(begin, pa.array(counts.astype(np.int64)))],
                ["doc_id", "n", "terms", "tfs"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _weighted(items: Items, counted: DataFrame, documents: int) -> None:
    """Give the items' terms their weights, by in how many documents each is."""
    size = len(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "df"])

    found = counted.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    items.weights = np.zeros(size, np.int64)
    for row in found.collect():
        items.weights[row["term"]] = weight(documents, row["df"])


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


# --- vectors ----------------------------------------------------------------


def vectors(counted: DataFrame, shared: Broadcast, documents: int, occurrences: int) -> DataFrame:
    """doc_id, terms, impacts and length of the vectors that are not null, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for batch in batches:
            doc_id, n, terms, tfs = batch.columns
            m = 50 + 50 * n.to_numpy() * documents // occurrences
            many = np.diff(terms.offsets.to_numpy())
            tf, place = _flat(tfs), _flat(terms)
            impacts = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, many))
            # Sums of a row alone: differences of a running sum would lose what is small beside it.
            square = weights[place].astype(np.float64) * impacts * impacts
            own = np.zeros(len(many))
            some = np.flatnonzero(many)
            if len(some):
                own[some] = np.add.reduceat(square, (np.cumsum(many) - many)[some])
            begin = pa.array((terms.offsets.to_numpy() - terms.offsets[0].as_py()).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [doc_id, terms, pa.ListArray.from_arrays(begin, pa.array(impacts)), pa.array(np.sqrt(own))],
                ["doc_id", "terms", "impacts", "length"])

    found = counted.mapInArrow(run, "doc_id bigint, terms array<int>, impacts array<bigint>, length double")
    found = found.where("length > 0").withColumn("row", F.monotonically_increasing_id())
    return found.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row").drop("row")


# --- search -----------------------------------------------------------------


class Bucket:
    """Some vectors by their terms: an inverted list for each."""

    def __init__(self, batch: pa.RecordBatch):
        names = batch.schema.names
        lists = batch.column(names.index("terms"))
        many = np.diff(lists.offsets.to_numpy())
        self.terms, self.impacts = _flat(lists), _flat(batch.column(names.index("impacts")))
        self.lengths = batch.column(names.index("length")).to_numpy()
        self.ids = batch.column(names.index("doc_id"))
        self.begin = np.concatenate([[0], np.cumsum(many)])
        owner = np.repeat(np.arange(len(many)), many)
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.owner, self.own_impacts = self.terms[order], owner[order], self.impacts[order]

    def postings(self, term: int) -> slice:
        return slice(*np.searchsorted(self.by_term, [term, term + 1]))

    def candidates(self, focus: np.ndarray, weights: np.ndarray, rest: float, threshold: int) -> np.ndarray:
        """Rows that may reach the threshold, by the heaviest terms and the length of what remains."""
        exact, square = np.zeros(len(self.lengths)), self.lengths ** 2
        for term in focus:
            own = self.postings(term)
            impacts, rows = self.own_impacts[own].astype(np.float64), self.owner[own]
            # A row has a term once, so rows are distinct here.
            exact[rows] += weights[term] * impacts
            square[rows] -= weights[term] * impacts ** 2
        # What is left may round to less than nothing; its error is bounded by the whole.
        square = np.maximum(square, 0) + 1e-9 * self.lengths ** 2
        return np.flatnonzero((exact + rest * np.sqrt(square)) * SLACK + 1 >= threshold)

    def scores(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; `values` has the item's weight for its terms, else 0."""
        many = self.begin[rows + 1] - self.begin[rows]
        place = np.repeat(self.begin[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.add.reduceat(values[self.terms[place]] * self.impacts[place], np.cumsum(many) - many)


class Best:
    """The best `most` (score, doc_id) of an item so far."""

    def __init__(self, most: int, threshold: int):
        self.most, self.threshold, self.heap = most, threshold, []

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        if len(scores) > 4 * self.most:
            good = np.flatnonzero(scores >= -np.partition(-scores, self.most - 1)[self.most - 1])
            scores, ids = scores[good], ids.take(pa.array(good))
        for score, doc_id in zip(scores.tolist(), ids.to_pylist()):
            # Larger is better: of equal scores the smaller id, null last.
            entry = (score, doc_id is not None, -(doc_id or 0))
            if len(self.heap) < self.most:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.most:
            self.threshold = max(self.threshold, self.heap[0][0])


def _cuts(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the buckets of a batch begin and end, given its rows' coordinates."""
    ends, low = np.cumsum(many), 0
    while low < len(many):
        before = ends[low - 1] if low else 0
        high = int(np.searchsorted(ends, before + COORDINATES, "right"))
        high = min(max(high, low + 1), low + BUCKET, len(many))
        yield low, high
        low = high


def _searched(found: DataFrame, shared: Broadcast, thresholds: np.ndarray, most: int) -> DataFrame:
    """item (place in the block), doc_id, score: each task's best of the vectors it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        weights = items.weights
        roots = np.array([math.sqrt(weights[h].sum()) for h in items.held])
        focus = [h[np.argsort(-weights[h], kind="stable")[:FOCUS]] for h in items.held]
        rest = [math.sqrt(weights[h].sum() - weights[f].sum()) for h, f in zip(items.held, focus)]
        best = [Best(most, max(1, int(t))) for t in thresholds]
        values = np.zeros(len(items.terms), np.int64)
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for low, high in _cuts(np.diff(batch.column(1).offsets.to_numpy())):
                bucket = None
                # Not the first: a bucket may begin at the end of one file and go on into one of longer vectors.
                longest = lengths[low:high].max()
                limits = np.array([b.threshold for b in best])
                for k in np.flatnonzero((roots > 0) & (longest * roots * SLACK + 1 >= limits)):
                    bucket = bucket or Bucket(batch.slice(low, high - low))
                    rows = bucket.candidates(focus[k], weights, rest[k], best[k].threshold)
                    if len(rows):
                        values[items.held[k]] = weights[items.held[k]]
                        scores = bucket.scores(rows, values)
                        values[items.held[k]] = 0
                        good = scores >= best[k].threshold
                        best[k].offer(scores[good], bucket.ids.take(pa.array(rows[good])))
        out = [(k, -e[2] if e[1] else None, e[0]) for k, b in enumerate(best) for e in b.heap if e[0] >= b.threshold]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int64())], ["item", "doc_id", "score"])

    return found.select("doc_id", "terms", "impacts", "length").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _length_of_longest(found: DataFrame, many: int) -> float:
    """A length that some `many` vectors reach, from counts by logarithm: a few hundred numbers."""
    steps = F.floor(F.log2("length") * 8).alias("step")
    counts = sorted(((r["step"], r["count"]) for r in found.groupBy(steps).count().collect()), reverse=True)
    for step, n in counts:
        many -= n
        if many <= 0:
            return 2.0 ** (step / 8)
    return 0.0


def _first(found: DataFrame, partition: list[str], most: int) -> DataFrame:
    along = Window.partitionBy(*partition).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= most)


def _block(documents: DataFrame, texts: list[str], most: int) -> DataFrame:
    """text, rank, doc_id, score of a block of distinct items."""
    spark = documents.sparkSession
    items = _items(texts)
    terms = spark.sparkContext.broadcast(items.terms)
    counted = written(term_counts(documents, terms), "terms")
    terms.destroy()
    totals = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    _weighted(items, counted, totals[0])
    shared = spark.sparkContext.broadcast(items)
    found = written(vectors(counted, shared, totals[0], totals[1] or 1), "vectors")
    # Thresholds from some of the longest vectors: no search can end below them.
    longest = found.where(F.col("length") >= _length_of_longest(found, SEED))
    thresholds = np.zeros(len(texts), np.int64)
    for row in _first(_searched(longest, shared, thresholds, most), ["item"], most).where(F.col("rank") == most).collect():
        thresholds[row["item"]] = row["score"]
    roots = [math.sqrt(items.weights[h].sum()) for h in items.held]
    # The length below which a vector is of no use to any item.
    least = min([(t - 1) / (r * SLACK) for t, r in zip(thresholds, roots) if r] or [0.0])
    useful = found.where(F.col("length") >= max(0.0, least * (1 - 1e-9)))
    best = _first(_searched(useful, shared, thresholds, most), ["item"], most)
    names = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
    best = written(best.join(names, "item").select("text", "rank", "doc_id", "score"), "found")
    shared.destroy()
    return best


def search(documents: DataFrame, items: DataFrame, most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of each item."""
    spark = documents.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    texts = written(named.select("text").distinct(), "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = spark.createDataFrame([], "text string, rank int, doc_id bigint, score bigint")
    for k in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        if held := [row["text"] for row in own.collect()]:
            found = found.unionByName(_block(documents, held, most))
    return named.join(found, "text").select("item_id", "rank", "doc_id", "score")
