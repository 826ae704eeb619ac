"""A quality classifier: random-indexing word vectors, pooled, then a small network.

Every token is hashed to one of CELLS cells and has a sparse random index vector.
A cell's word vector is the sum of the index vectors of all tokens near its own,
over all documents; tasks send partial sums by range of cells, so what travels is
bounded.  A document's features are the mean and the spread of its tokens' unit
vectors.  A network of two layers, in numpy, learns the labels from at most
SAMPLE labelled documents; a part of them sets the temperature of its
probabilities.

Cases: an empty or null text has the features of no tokens, zeros, and gets a
score like any other; rows repeat as they come, a null doc_id has no label; without
labels of both kinds every score is the share of label 1, or 0.5; other columns are
carried along, but for one of the name of the result, which is replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.labelled import sample, with_score
from tidemark.llm.words import SIGNS, Words, mix, pieces

CELLS, DIMS, NEAR = 1 << 14, 32, 2
#: Most labelled documents the network learns from.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
_PARTS = 16
_U = np.uint64


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Four dimensions and signs of each cell's index vector."""
    bits = mix(np.arange(CELLS * 4, dtype=_U) + _U(0x5EED)).reshape(CELLS, 4)
    return (bits % _U(DIMS)).astype(np.int64), np.where(bits >> _U(63), 1.0, -1.0)


def _cells(words: Words) -> np.ndarray:
    return (words.hashes & _U(CELLS - 1)).astype(np.int64)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The unit word vector of each cell, from all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS * DIMS)
        dims, signs = _index()
        for _, data, offsets in pieces(batches, "text"):
            words = Words(data, offsets, SIGNS)
            cells = _cells(words)
            for away in range(1, NEAR + 1):
                same = words.text[away:] == words.text[:-away]
                left, right = cells[:-away][same], cells[away:][same]
                for a, b in ((left, right), (right, left)):
                    for k in range(4):
                        total += np.bincount(a * DIMS + dims[b, k], signs[b, k], CELLS * DIMS)
        blocks = total.reshape(_PARTS, -1)
        seen = [k for k in range(_PARTS) if blocks[k].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array([blocks[k].astype("<f4").tobytes() for k in seen], pa.binary())], ["part", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, "<f4").astype("<f8") for b in table.column("sums").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    partial = documents.select("text").mapInArrow(run, "part int, sums binary")
    vectors = np.zeros((_PARTS, CELLS * DIMS // _PARTS))
    for row in partial.groupBy("part").applyInArrow(add, "part int, sums binary").collect():
        vectors[row["part"]] = np.frombuffer(row["sums"], "<f8")
    vectors = vectors.reshape(CELLS, DIMS)
    # A cell that nothing was near keeps a zero vector.
    return (vectors / np.maximum(np.sqrt((vectors ** 2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of its tokens."""
    words = Words(data, offsets, SIGNS)
    cells = _cells(words)
    sums = np.zeros((len(words.counts), 2 * DIMS))
    # Some tokens at a time; a text may reach over several of these.
    for low in range(0, len(cells), 65536):
        some, text = vectors[cells[low:low + 65536]], words.text[low:low + 65536]
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sums[text[begins], :DIMS] += np.add.reduceat(some, begins, axis=0)
        sums[text[begins], DIMS:] += np.add.reduceat(some * some, begins, axis=0)
    n = np.maximum(words.counts, 1)[:, None]
    mean, square = sums[:, :DIMS] / n, sums[:, DIMS:] / n
    return np.hstack([mean, np.sqrt(np.maximum(square - mean ** 2, 0)), np.log1p(words.counts)[:, None]])


@dataclass
class Network:
    """Two layers over standardised features; probabilities at a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss; a fifth of the rows, left out, sets the temperature."""
    random = np.random.Generator(np.random.PCG64(seed))
    width = x.shape[1]
    centre = x.mean(0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(width)
    if len(np.unique(y)) < 2:
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        flat = [np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(share / (1 - share))])]
        return Network(centre, scale, flat)
    order = random.permutation(len(x))
    apart = len(x) // 5
    rest, own = order[:apart], order[apart:]
    weights = [random.standard_normal((width, HIDDEN)) / np.sqrt(width), np.zeros(HIDDEN),
               random.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN), np.zeros(1)]
    net = Network(centre, scale, weights)
    z = (x - centre) / scale
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        random.shuffle(own)
        for low in range(0, len(own), BATCH):
            rows = own[low:low + BATCH]
            inner = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-(inner @ weights[2] + weights[3]))) - y[rows, None]) / len(rows)
            back = error @ weights[2].T * (1 - inner ** 2)
            step += 1
            for w, g, m, s in zip(weights, (z[rows].T @ back, back.sum(0), inner.T @ error, error.sum(0)), means, squares):
                g = g + DECAY * w
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    if apart:
        logits, truth = net.logits(x[rest]), y[rest]
        losses = {t: np.logaddexp(0, -logits / t * (2 * truth - 1)).mean() for t in np.geomspace(0.25, 8, 41)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents and the network fit to `labels` (doc_id, label)."""
    vectors = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            found = features(data, offsets, shared.value)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    own = documents.select("doc_id", "text").join(F.broadcast(sample(labels, most)), "doc_id").select("doc_id", "label", "text")
    table = own.mapInArrow(run, "doc_id bigint, label int, x array<double>").orderBy("doc_id").toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 2 * DIMS + 1))
    return vectors, fit(x, table["label"].to_numpy().astype(float))


def scored(documents: DataFrame, vectors: np.ndarray, network: Network, into: str = "score") -> DataFrame:
    """`documents` with the score of each row in the column `into`."""
    return with_score(documents, (vectors, network), lambda own, data, offsets: own[1].score(features(data, offsets, own[0])), into)
