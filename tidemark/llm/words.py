"""Words of many texts at once: numpy over the bytes of an Arrow column.

A batch is cut into pieces of a MB, so a task's memory depends on the piece
and the longest text only.  Words get 64-bit hashes that depend on their bytes
alone.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructField, StructType, DataType

PIECE_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_C = ctypes.CDLL(None)


def charset(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Everything but white space: [^\x20\x09-\x0D].
NOT_SPACE = ~charset((0x20, 0x20), (0x09, 0x0D))
#: 1 for digits, letters and all that is not ASCII, 2 for the other signs: runs of signs are words too.
SIGNS = np.where(NOT_SPACE, 2, 0).astype(np.uint8)
#: Digits, letters and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F], once lower-cased.
ALNUM = ~charset((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SIGNS[ALNUM] = 1
SIGNS[65:91] = 1


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[tuple]:
    """(rows, bytes, offsets) of runs of rows that hold at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            low, high = int(offsets[start]), int(offsets[stop])
            yield batch.slice(start, stop - start), data[low:high], offsets[start:stop + 1] - low
            start = stop
    released()


def released() -> None:
    """Give memory that is free back to the system: a worker waits for its next task with what it needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_C, "malloc_trim", None):
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each text begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one to one."""
    values = (values ^ (values >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U(27))) * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def widened(schema: StructType, **types: DataType) -> StructType:
    """A schema with columns added."""
    return StructType([*schema.fields, *[StructField(name, kind) for name, kind in types.items()]])


class Words:
    """The words of some texts: where they lie (`starts`, `ends`), their `hashes`, and the
    number of each one's text (`text`); text i has the words first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        """`member` tells which bytes are part of words: 0 for none; a run of one number is a word."""
        kind = member[data].astype(np.uint8)
        bound = np.ones(len(data) + 1, bool)
        bound[1:-1] = kind[1:] != kind[:-1]
        bound[offsets] = True
        self.starts = np.flatnonzero(bound[:-1] & (kind > 0))
        self.ends = np.flatnonzero(bound[1:] & (kind > 0)) + 1
        self.hashes = run_hashes(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), _BASE, _U))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power, out=sums[1:])
        del power
        back = np.cumprod(np.full(len(data), _INVERSE, _U))
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))


def grams(words: Words, size: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and where each begins.

    With `whole`, a text of fewer words, but some, gives all its words as one run.
    """
    position = np.arange(max(0, len(words.hashes) - size + 1))
    position = position[words.text[position] == words.text[position + size - 1]] if len(position) else position
    found = [(position, joined(words.hashes, position, size))]
    if whole:
        for n in range(1, size):
            begin = words.first[:-1][words.counts == n]
            found.append((begin, joined(words.hashes, begin, n)))
    return np.concatenate([h for _, h in found]), np.concatenate([p for p, _ in found])


def joined(hashes: np.ndarray, position: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each position on."""
    with np.errstate(over="ignore"):
        total = np.full(len(position), size, _U)
        for k in range(size):
            total = total * _U(0xD1342543DE82EF95) + hashes[position + k]
        return mix(total)
