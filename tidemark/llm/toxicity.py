"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

The models predict each byte of a word from up to five before it, back to the
word's start.  The highest order counts toxic and ordinary documents apart; all
lower orders are shared by both classes and count distinct continuations (raw
counts where a gram begins a word, as nothing stands before it).  A class that has
met a context seldom leans on the counts of both classes for it, so what is merely
rare speaks for neither.  Counts cover all labelled documents that may be learnt
from.

A word's evidence is its toxic minus its ordinary log-likelihood.  A document is
judged by the two log-likelihoods normalised by its length, by the same in its
most toxic window, and by its two most toxic words; a logistic fit turns these
into a score.  It learns from documents scored by models of the other half of the
labelled documents, at most SAMPLE of them.

The evidence of every gram and context goes to the tasks, in broadcast blocks of
about BLOCK grams.  Driver and tasks hold one block of a table at a time, so none is
dropped and memory stays bounded.

Cases: an empty or null text has no evidence, zeros, and a score like any other;
repeated rows are scored each, with a null doc_id too, which no label is of; without
labels of both kinds every score is 0; other columns are carried along, but for one of
the name of the result, which is replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.labelled import sample, with_score
from tidemark.llm.words import ALNUM, LOWER, Words, mix, pieces
from tidemark.session import written

ORDER, DISCOUNT, WINDOW = 6, 0.75, 10
#: A class counts as much as both together once it has met a context so often.
LEAN = 4.0
SAMPLE = 20_000
#: Grams in a broadcast: 12 bytes each.
BLOCK = 1 << 21
#: Models: of the one half of the documents, of the other, of all.
HALVES, ALL = 2, 2
_FLUSH = 500_000
_U = np.uint64


# --- grams ------------------------------------------------------------------


class Vocabulary:
    """The distinct words of a piece, and their grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.words = Words(data, offsets, ALNUM)
        _, first, self.which = np.unique(self.words.hashes, return_index=True, return_inverse=True)
        starts, ends = self.words.starts[first], self.words.ends[first]
        self.lengths = ends - starts
        # Each word as a space and its bytes.
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        age = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], self.lengths + 1)
        letters = np.full(self.begin[-1], 32, np.int64)
        letters[age > 0] = data[np.repeat(starts, self.lengths) + age[age > 0] - 1]
        self.grams = letters.copy()
        for k in range(1, ORDER):
            self.grams[k:] |= np.where(age[k:] >= k, letters[:-k] << (8 * k), 0)
        # The space itself is given, not predicted.
        self.predicted = age > 0

    def per_word(self, evidence: np.ndarray) -> np.ndarray:
        """The sum of each distinct word's evidence, given its grams'."""
        if not len(self.lengths):
            return np.zeros(0)
        return np.add.reduceat(np.where(self.predicted, evidence, 0.0), self.begin[:-1])


def _counted(labelled: DataFrame) -> DataFrame:
    """gram, label, half, n of the documents (label, half, text)."""
    def merged(held: list) -> pa.RecordBatch:
        grams, group, n = [np.concatenate(x) for x in zip(*held)]
        order = np.lexsort((group, grams))
        grams, group, n = grams[order], group[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (group[1:] != group[:-1])]))
        return pa.RecordBatch.from_arrays(
            [pa.array(grams[first]), pa.array(group[first] % 2, pa.int32()), pa.array(group[first] // 2, pa.int32()),
             pa.array(np.add.reduceat(n, first))], ["gram", "label", "half", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for rows, data, offsets in pieces(batches, "text"):
            vocabulary = Vocabulary(data, offsets)
            group_of = rows.column(0).to_numpy() + 2 * rows.column(1).to_numpy()
            group = group_of[vocabulary.words.text]
            size = len(vocabulary.lengths)
            uses = np.bincount(vocabulary.which * 4 + group, minlength=4 * size).reshape(size, 4)
            owner = np.repeat(np.arange(size), vocabulary.lengths + 1)
            for g in range(4):
                n = uses[owner, g]
                used = vocabulary.predicted & (n > 0)
                if used.any():
                    grams, which = np.unique(vocabulary.grams[used], return_inverse=True)
                    held.append((grams, np.full(len(grams), g), np.bincount(which, n[used]).astype(np.int64)))
                    many += len(grams)
            if many > _FLUSH:
                yield merged(held)
                held, many = [], 0
        if held:
            yield merged(held)

    rows = labelled.select(F.col("label").cast("long"), F.col("half").cast("long"), "text")
    return rows.mapInArrow(run, "gram bigint, label int, half int, n bigint").groupBy("gram", "label", "half").agg(F.sum("n").alias("n"))


# --- models -----------------------------------------------------------------


def _suffix(column: str, order: int):
    return F.col(column).bitwiseAND(F.lit((1 << (8 * order)) - 1))


def models(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, gram, evidence) of grams, and of contexts for grams never met."""
    # A model of one half is for the other half's documents.
    uses = counts.withColumn("model", F.explode(F.array(F.lit(ALL), 1 - F.col("half"))))
    top = written(uses.groupBy("model", "gram").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0")), "grams")
    # Shared orders from below: p of each gram, given the one below.
    level = top.select("model", "gram", (F.col("n1") + F.col("n0")).alias("n"))
    below = []
    for order in range(ORDER - 1, 1, -1):
        # A gram with fewer bytes than the order above begins a word.
        starts_word = F.shiftright("gram", 8 * order) == 0
        level = level.groupBy("model", _suffix("gram", order).alias("gram")).agg(
            F.sum(F.when(starts_word, F.col("n")).otherwise(1)).alias("n"))
        below.append((order, level))
    shared = None
    for order, level in reversed(below):
        totals = level.groupBy("model", F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("types"))
        own = level.withColumn("context", F.shiftright("gram", 8)).join(totals, ["model", "context"])
        if shared is None:
            own = own.withColumn("p_below", F.lit(1 / 256))
        else:
            lower = shared.select("model", F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
            own = own.withColumn("suffix", _suffix("gram", order - 1)).join(lower, ["model", "suffix"])
        shared = own.select("model", "gram", (
            (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("p_below")) / F.col("total")).alias("p"))
    contexts = written(top.groupBy("model", F.shiftright("gram", 8).alias("context")).agg(
        *[F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)],
        *[F.sum((F.col(f"n{c}") > 0).cast("int")).alias(f"types{c}") for c in (0, 1)],
        F.count("*").alias("types2")), "contexts")

    def n(c: int):
        return F.col("n1") + F.col("n0") if c == 2 else F.col(f"n{c}")

    def total(c: int):
        return F.col("total1") + F.col("total0") if c == 2 else F.col(f"total{c}")

    def estimate(c: int, met, below):
        """Of one class or of both: discounted counts, and the rest by the shared orders."""
        types = F.col(f"types{c}")
        return F.when(total(c) > 0, (met + DISCOUNT * types * below) / total(c)).otherwise(below)

    def evidence(met, below):
        both = estimate(2, met(2), below)
        leaning = [(total(c) * estimate(c, met(c), below) + LEAN * both) / (total(c) + LEAN) for c in (0, 1)]
        return F.log(leaning[1] / leaning[0]).alias("evidence")

    lower = shared.select("model", F.col("gram").alias("suffix"), "p")
    grams = (
        top.withColumn("context", F.shiftright("gram", 8)).withColumn("suffix", _suffix("gram", ORDER - 1))
        .join(contexts, ["model", "context"]).join(lower, ["model", "suffix"])
        .select("model", "gram", evidence(lambda c: F.greatest(n(c) - DISCOUNT, F.lit(0.0)), F.col("p")))
    )
    # All that a gram never met has is the shared part, whose size cancels out.
    unmet = contexts.select("model", F.col("context").alias("gram"), evidence(lambda c: F.lit(0.0), F.lit(1.0)))
    return grams, unmet


class Table:
    """The evidence of all grams: blocks of (sorted grams, evidence), each a broadcast."""

    def __init__(self, blocks: list[Broadcast]):
        self.blocks = blocks

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is in the table, and its evidence."""
        asked, which = np.unique(grams, return_inverse=True)
        known, evidence = np.zeros(len(asked), bool), np.zeros(len(asked), np.float32)
        own = _block_of(asked, len(self.blocks))
        for k, block in enumerate(self.blocks):
            at = np.flatnonzero(own == k)
            keys, values = _loaded(block, len(self.blocks) == 1)
            place = np.minimum(np.searchsorted(keys, asked[at]), len(keys) - 1)
            same = keys[place] == asked[at]
            known[at[same]], evidence[at[same]] = True, values[place[same]]
        return known[which], evidence[which]

    def destroy(self) -> None:
        for block in self.blocks:
            block.destroy()


def _loaded(block: Broadcast, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """The value, kept in the process only on demand; an encrypted one is there already."""
    path = getattr(block, "_path", None)
    return block.value if keep or path is None else block.load_from_path(path)


def _block_of(grams: np.ndarray, number: int) -> np.ndarray:
    return (mix(grams.astype(_U)) % _U(max(1, number))).astype(np.int32)


def _table(rows: DataFrame, model: int) -> Table:
    own = rows.where(F.col("model") == model).select("gram", F.col("evidence").cast("float").alias("evidence"))
    number = -(-own.count() // BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = pa.array(_block_of(batch.column(0).to_numpy(), number))
            yield pa.RecordBatch.from_arrays([block, *batch.columns], ["block", "gram", "evidence"])

    if number > 1:
        # In order, so that each block is read alone.
        placed = own.mapInArrow(place, "block int, gram bigint, evidence float")
        own = written(placed.sortWithinPartitions("block"), "blocks")
    blocks = []
    for k in range(number):
        found = (own.where(F.col("block") == k) if number > 1 else own).select("gram", "evidence").toArrow()
        # An empty block would have no gram to compare with.
        grams = found["gram"].to_numpy() if len(found) else np.full(1, -1)
        evidence = found["evidence"].to_numpy() if len(found) else np.zeros(1, np.float32)
        order = np.argsort(grams)
        blocks.append(rows.sparkSession.sparkContext.broadcast((grams[order], evidence[order])))
    return Table(blocks)


# --- scores -----------------------------------------------------------------


def features(data: np.ndarray, offsets: np.ndarray, met: Table, unmet: Table) -> np.ndarray:
    """By document: evidence per byte, in the most toxic window per word, of the two most toxic words, log of words."""
    vocabulary = Vocabulary(data, offsets)
    words = vocabulary.words
    seen, own = met.find(vocabulary.grams)
    known, other = unmet.find(vocabulary.grams >> 8)
    word = vocabulary.per_word(np.where(seen, own, np.where(known, other, 0.0)))[vocabulary.which]
    found = np.zeros((len(words.counts), 5))
    some = np.flatnonzero(words.counts)
    if not len(some):
        return found
    first = words.first[some]
    size = np.add.reduceat(words.ends - words.starts, first)
    found[some, 0] = np.add.reduceat(word, first) / size
    # Windows end at each word and do not reach back over the document's start.
    sums = np.concatenate([[0.0], np.cumsum(word)])
    place = np.arange(len(word))
    low = np.maximum(place + 1 - WINDOW, words.first[words.text])
    found[some, 1] = np.maximum.reduceat((sums[place + 1] - sums[low]) / WINDOW, first)
    top = np.maximum.reduceat(word, first)
    found[some, 2] = top
    order = np.lexsort((-word, words.text))
    second = np.where(words.counts[some] > 1, word[order[np.minimum(first + 1, len(word) - 1)]], 0.0)
    found[some, 3] = second
    found[some, 4] = np.log1p(words.counts[some])
    return found


@dataclass
class Fit:
    """A logistic fit over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        z = np.hstack([(x - self.centre) / self.scale, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Fit:
    """Newton steps with a small penalty."""
    if len(np.unique(y)) < 2:
        return Fit(np.zeros(5), np.ones(5), None)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    weights, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], 0.1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (p - y) + penalty * weights
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        weights = weights - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Fit(centre, scale, weights)


@dataclass
class Model:
    met: Table
    unmet: Table
    fit: Fit | None = None


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of all of `labels` (doc_id, label)."""
    halved = labels.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(HALVES)).cast("int"))
    counts = written(_counted(documents.select("doc_id", "text").join(halved, "doc_id")), "counts")
    grams, unmet = [written(df, "evidence") for df in models(counts)]
    halves = [Model(_table(grams, k), _table(unmet, k)) for k in range(HALVES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            both = np.stack([features(data, offsets, m.met, m.unmet) for m in halves])
            own = both[rows.column(2).to_numpy(), np.arange(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(own), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    own = documents.select("doc_id", "text").join(F.broadcast(sample(halved, most)), "doc_id").select("doc_id", "label", "half", "text")
    table = own.mapInArrow(run, "doc_id bigint, label int, x array<double>").orderBy("doc_id").toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 5))
    for half in halves:
        half.met.destroy()
        half.unmet.destroy()
    return Model(_table(grams, ALL), _table(unmet, ALL), fit(x, table["label"].to_numpy().astype(float)))


def scored(documents: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """`documents` with the score of each row in the column `into`."""
    met, unmet = model.met, model.unmet
    return with_score(documents, model.fit, lambda own, data, offsets: own.score(features(data, offsets, met, unmet)), into)
