"""Byte-level BPE of many pieces at once, in padded matrices; and decoding.

A text is cut by the public pattern; merges never cross a cut.  New pieces of a
batch are filed by length into matrices of token ids, one piece a row, padded to
the bucket's width.  A round merges in every row the leftmost of its pairs of
minimum rank: the pair's first cell takes the merged id, the cells after it move
up by one, and only the two ranks beside it are looked up anew.  Rows without a
pair to merge leave the matrix (compaction).  Ranks come from a hash table of
pairs, probed for a whole column of pairs at once.

A row of more than LONG bytes merges, in a round, all occurrences of its minimum
rank up to the first that makes a pair of smaller rank: what one merge a round
would come to, without a round for every byte.

Ids are ranks of a file of base64 tokens, one a line.  A pair may merge if its two
byte strings put together are a token; a piece that is a token as a whole is that
token.

Cases: a null text is an empty one and has no tokens; null ids decode to null;
repeated rows are encoded each; other columns are carried along, but for one of the
name of the result, which is replaced; no rows give no rows.
"""

import base64
import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tidemark.llm.words import widened

#: Fixed value: the public pattern that cuts text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows longer than this merge more than one pair a round.
LONG = 256
#: Cells of a matrix, and bytes of text that go through together.
CELLS, TEXT_BYTES = 1 << 18, 1 << 20
#: Pieces a worker remembers, as many again from before these, and the longest it does.
REMEMBERED, LONGEST = 300_000, 64
NONE = np.int32(2 ** 31 - 1)
_U = np.uint64


class Pairs:
    """A hash table of pairs of ids that merge: open addresses, found for many pairs at once.

    The merged id is also the pair's rank.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.shift = 64 - max(4, (4 * max(1, len(left)) - 1).bit_length())
        size = 1 << (64 - self.shift)
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, rest = self._slots(keys), np.arange(len(keys))
        self.probes = 1
        while len(rest):
            # Of several keys that want a free slot, the first gets it.
            free = rest[self.keys[slots[rest]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], merged[placed]
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & self.mask
            self.probes += len(rest) > 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(self.shift)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE if it does not merge, as with padding (-1)."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            held = self.keys[slots[open_]]
            same = held == keys[open_]
            found[open_[same]] = self.ranks[slots[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return found


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the search for cycles, of which millions of pieces and ids have none."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


class Codec:
    """A vocabulary of byte strings with their ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, file))}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        ways = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items()
                for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = Pairs(*np.array(ways, np.int64).reshape(-1, 3).T)
        self.pattern = regex.compile(PATTERN)
        # One object for each id, whatever remembers it.
        self.own = {rank: rank for rank in self.bytes}
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        with _uncollected():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pattern.findall(text) for text in texts]
        known = self.remembered
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED:
            # What is in use comes over from the earlier ones; the rest goes with the next change.
            self.earlier, known = known, {}
            self.remembered, new = known, set().union(*cut)
        earlier = self.earlier
        rest = []
        for piece in new:
            ids = earlier.get(piece)
            if ids is not None:
                known[piece] = ids
                continue
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is None:
                rest.append((piece, data))
            else:
                known[piece] = (whole,)
        known.update(zip([piece for piece, _ in rest], self.merged([data for _, data in rest])))
        ids = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in cut]
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        return ids

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, by rounds of merges."""
        result: list[tuple[int, ...]] = [()] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        low = 0
        while low < len(order):
            # A bucket: rows of up to a power of two, or one long row.
            width = 1 << int(max(1, lengths[order[low]]) - 1).bit_length()
            if lengths[order[low]] > LONG:
                result[order[low]] = tuple(self._long(self.first[np.frombuffer(pieces[order[low]], np.uint8)]).tolist())
                low += 1
                continue
            high = min(int(np.searchsorted(lengths[order], width, "right")), low + max(1, CELLS // width))
            rows = order[low:high]
            matrix = np.full((len(rows), width), -1, np.int32)
            filled = np.arange(width) < lengths[rows, None]
            matrix[filled] = self.first[np.frombuffer(b"".join([pieces[k] for k in rows]), np.uint8)]
            self._rounds(matrix, lengths[rows].copy(), rows, result)
            low = high
        return result

    def _rounds(self, ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, result: list) -> None:
        """Merge a matrix to its end; each row's ids go to `result` as it leaves."""
        own = self.own.__getitem__
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            at = ranks.argmin(1)
            here = np.arange(len(ids))
            least = ranks[here, at]
            done = least == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    result[rows[k]] = tuple(map(own, ids[k, :sizes[k]].tolist()))
                go = ~done
                # The widest row left bounds the matrix.
                width = int(sizes[go].max(initial=1))
                ids, ranks, sizes, rows = ids[go, :width], ranks[go, :width], sizes[go], rows[go]
                at, least, here = at[go], least[go], here[:go.sum()]
                if not len(ids):
                    break
            last = ids.shape[1] - 1
            ids[here, at] = least
            source = np.arange(last)
            source = np.where(source > at[:, None], source + 1, source)
            ids[:, :-1], ranks[:, :-1] = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            sizes -= 1
            right = np.where(at < last, ids[here, np.minimum(at + 1, last)], -1)
            left = np.where(at > 0, ids[here, np.maximum(at - 1, 0)], -1)
            ranks[here, at] = self.pairs.find(ids[here, at], right)
            inner = at > 0
            ranks[here[inner], at[inner] - 1] = self.pairs.find(left, ids[here, at])[inner]

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long row."""
        while len(ids) > 1:
            ranks = self.pairs.find(ids[:-1], ids[1:])
            least = ranks.min()
            if least == NONE:
                break
            at = np.flatnonzero(ranks == least)
            # Of pairs that overlap (aaa) every second one, from the left of each run.
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = at[(np.arange(len(at)) - starts[run - 1]) % 2 == 0]
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            # The merge before this one may end where this one begins.
            joined = np.concatenate([[False], at[1:] == at[:-1] + 2])
            before[joined] = least
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), least, np.int32)
            less = np.flatnonzero(np.minimum(self.pairs.find(before.astype(np.int32), merged),
                                             self.pairs.find(merged, after.astype(np.int32))) < least)
            if len(less):
                at = at[:less[0] + 1]
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of some TEXT_BYTES, and where each begins."""
    held, size, begin = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > TEXT_BYTES:
            yield begin, held
            held, size, begin = [], 0, k + 1
    if held:
        yield begin, held


def encode(documents: DataFrame, path: str, column: str = "text", into: str = "token_ids") -> DataFrame:
    """`documents` with the ids of each text."""
    source = documents.drop(into)
    schema = widened(source.schema, **{into: ArrayType(IntegerType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for begin, texts in _runs(batch.column(batch.schema.get_field_index(column))):
                ids = pa.array(own.encode(texts), pa.list_(pa.int32()))
                rows = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*rows.schema.names, into])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of each row's ids."""
    source = encoded.drop(into)
    schema = widened(source.schema, **{into: BinaryType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                lists = rows.column(rows.schema.get_field_index(ids)).to_pylist()
                found = [None if x is None else own.decode(x) for x in lists]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())],
                                                 [*rows.schema.names, into])

    return source.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes: both ways in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        number = {rank: str(rank) for rank in own.bytes}
        for batch in batches:
            for begin, texts in _runs(batch.column(1)):
                encoded = own.encode(texts)
                first = [hashlib.sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest() for ids in encoded]
                second = [hashlib.sha256(own.decode(ids)).hexdigest() for ids in encoded]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array([len(ids) for ids in encoded], pa.int64()),
                     pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
