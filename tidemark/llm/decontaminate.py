"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is `size` consecutive words of an item, or all words of a shorter one.
Its set is its shingles of `shingle` words.  A document must hold the whole set,
so one shingle is the necessary prefix: the window's rarest over the documents.
A document's shingles that are some window's prefix give candidates; one whose
window would begin before or end after the document is out (length and position);
the rest are verified word by word, by the words' 64-bit hashes.

The windows go in blocks of about BLOCK, each broadcast to one pass over the
documents and freed after it.  The driver holds two blocks at most, so neither
the windows' number nor any document's is bounded; a benchmark of several blocks
takes a pass and a written copy of the documents for each but the last.

Cases: null and empty texts have no words; items without words have no window;
the windows of items without an id hit like others, but there is nothing to name;
items with equal windows are all found; repeated documents are judged each; an empty
benchmark leaves all documents clean; `marked` replaces columns of the names it
adds, `clean` gives back all columns as they were.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from tidemark.llm.labelled import fresh
from tidemark.llm.words import ALNUM, LOWER, Words, grams, joined, pieces, widened
from tidemark.session import written

SIZE, SHINGLE = 10, 5
#: Windows in a broadcast: some 100 bytes each.
BLOCK = 200_000
ADDED = {"n_words": "bigint", "n_hit": "bigint", "item_ids": "array<string>", "spans": "array<array<bigint>>"}


def item_windows(benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: their word hashes, the shingles' hashes (by place), and the items they occur in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            words = Words(LOWER[data], offsets, ALNUM)
            ids, hashes, tokens = [], [], []
            for k, item in enumerate(rows.column(0).to_pylist()):
                own = words.hashes[words.first[k]:words.first[k + 1]]
                for at in range(max(1, len(own) - size + 1) if len(own) else 0):
                    window = own[at:at + size]
                    gram = min(shingle, len(window))
                    ids.append(item)
                    hashes.append(window.view(np.int64))
                    tokens.append(joined(window, np.arange(len(window) - gram + 1), gram).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))],
                ["item_id", "words", "shingles"])

    found = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id bigint, words array<bigint>, shingles array<bigint>")
    return found.distinct()


def counts(documents: DataFrame, wanted: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each of the `wanted` shingles (sorted hashes, those of a block) occurs in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total = np.zeros(len(table), np.int64)
        for _, data, offsets in pieces(batches, "text"):
            words = Words(LOWER[data], offsets, ALNUM)
            for n in sizes:
                hashes = grams(words, n)[0]
                place = np.searchsorted(table, hashes)
                place[place == len(table)] = 0
                total += np.bincount(place[table[place] == hashes], minlength=len(table))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(table[seen].view(np.int64)), pa.array(total[seen])], ["token", "n"])

    found = documents.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    told = {r["token"]: r["n"] for r in found.collect()}
    shared.destroy()
    return told


class Block:
    """Some windows, filed under their rarest shingle."""

    def __init__(self, rows: list, size: int):
        windows: dict[tuple, list] = {}
        for r in rows:
            windows.setdefault(tuple(r["words"]), [r["token"], r["offset"], []])[2].append(r["item_id"])
        keys = sorted(windows, key=lambda w: windows[w][0] & (2 ** 64 - 1))
        self.tokens = np.array([windows[w][0] for w in keys], np.int64).view(np.uint64)
        self.offsets = np.array([windows[w][1] for w in keys], np.int64)
        self.lengths = np.array([len(w) for w in keys], np.int64)
        self.words = np.zeros((len(keys), size), np.uint64)
        for k, w in enumerate(keys):
            self.words[k, :len(w)] = np.array(w, np.int64).view(np.uint64)
        self.items = [sorted(set(windows[w][2]) - {None}) for w in keys]
        self.sizes = sorted({r["gram"] for r in rows})

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The windows that occur and where each begins."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in self.sizes:
            hashes, position = grams(words, n)
            low = np.searchsorted(self.tokens, hashes, "left")
            inside = low < len(self.tokens)
            at = np.flatnonzero(inside)[self.tokens[low[inside]] == hashes[inside]]
            # Some at a time: a common prefix has many windows.
            for some in np.array_split(at, len(at) // 10_000 + 1):
                many = np.searchsorted(self.tokens, hashes[some], "right") - low[some]
                window = np.repeat(low[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
                begin = np.repeat(position[some], many) - self.offsets[window]
                text = words.text[np.repeat(position[some], many)]
                fits = (begin >= words.first[text]) & (begin + self.lengths[window] <= words.first[text + 1])
                window, begin = window[fits], begin[fits]
                same = np.ones(len(window), bool)
                for k in range(self.words.shape[1]):
                    k_in = k < self.lengths[window]
                    place = np.where(k_in, begin + k, begin)
                    same &= ~k_in | (words.hashes[place] == self.words[window, k])
                found.append((window[same], begin[same]))
        return np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found])


def blocks(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE,
           most: int = BLOCK) -> Iterator[Block]:
    """All windows, at most about `most` at a time, with their necessary shingle."""
    windows = written(item_windows(benchmark, size, shingle), "windows")
    number = -(-windows.count() // most)
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, number))))
    for k in range(number):
        own = dealt.where(F.col("block") == k)
        tokens = own.select(F.explode("shingles").alias("token")).distinct()
        wanted = np.sort(np.array([r[0] for r in tokens.collect()], np.int64).view(np.uint64))
        gram = F.least(F.size("words"), F.lit(shingle))
        sizes = [r[0] for r in own.select(gram).distinct().collect()]
        told = counts(documents, wanted, sizes)
        rows = []
        for r in own.select("item_id", "words", "shingles", gram.alias("gram")).collect():
            offset, token = min(enumerate(r["shingles"]), key=lambda x: (told.get(x[1], 0), x[1]))
            # A shingle that no document holds rules its window out.
            if told.get(token, 0):
                rows.append({"item_id": r["item_id"], "words": r["words"], "token": token, "offset": offset, "gram": r["gram"]})
        if rows:
            yield Block(rows, size)


def marked(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE,
           most: int = BLOCK) -> DataFrame:
    """`documents` with n_words, n_hit, item_ids (sorted as strings) and spans (first and last word hit, by block)."""
    result = documents.drop(*ADDED)
    plain = result
    for name in ("item_ids", "spans"):
        result = result.withColumn(name, F.array().cast(ADDED[name]))
    found = blocks(plain, benchmark, size, shingle, most)
    block, after = next(found, None), next(found, None)
    while after is not None:
        shared = documents.sparkSession.sparkContext.broadcast(block)
        result = written(_marked(result, shared, False), "marked")
        shared.destroy()
        block, after = after, next(found, None)
    return _marked(result, documents.sparkSession.sparkContext.broadcast(block), True)


def _marked(documents: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
    """`documents` with what a block (None: no windows) finds added; the last call counts the words."""
    schema = documents.schema
    if last:
        schema = widened(schema, n_words=LongType(), n_hit=LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in pieces(batches, "text"):
            names = rows.schema.names
            words = Words(LOWER[data], offsets, ALNUM)
            items = rows.column(names.index("item_ids")).to_pylist()
            spans = rows.column(names.index("spans")).to_pylist()
            if own is not None:
                window, begin = own.hits(words)
                order = np.argsort(begin, kind="stable")
                for w, b in zip(window[order], begin[order]):
                    text = words.text[b]
                    first, stop = int(b - words.first[text]), int(b - words.first[text] + own.lengths[w])
                    items[text] = _union(items[text], own.items[w])
                    if spans[text] and spans[text][-1][0] <= first <= spans[text][-1][1]:
                        spans[text][-1][1] = max(stop, spans[text][-1][1])
                    else:
                        spans[text].append([first, stop])
            columns = dict(zip(names, rows.columns))
            columns["item_ids"] = pa.array([sorted(i) for i in items], pa.list_(pa.string()))
            columns["spans"] = pa.array(spans, pa.list_(pa.list_(pa.int64())))
            if last:
                columns["n_words"] = pa.array(words.counts)
                columns["n_hit"] = pa.array([_covered(s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return documents.mapInArrow(run, schema)


def _union(known: list[str] | set[str], more: list[int]) -> set[str]:
    known = known if isinstance(known, set) else set(known)
    known.update(map(str, more))
    return known


def _covered(spans: list[list[int]]) -> int:
    """How many words lie in any span."""
    total, reached = 0, 0
    for first, stop in sorted(spans):
        total += max(0, stop - max(first, reached))
        reached = max(reached, stop)
    return total


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item."""
    # Columns of the names that `marked` adds wait under others.
    taken = list(documents.columns)
    names = {c: fresh(c + "_", taken) for c in taken if c.lower() in ADDED}
    kept = marked(documents.withColumnsRenamed(names), benchmark).where("n_hit = 0")
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in taken])
