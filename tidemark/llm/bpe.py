"""Byte-level BPE: encoding by a priority queue of merge ranks, and decoding.

A text is cut at special tokens, then by the public byte-level pattern into
pieces, which merges never cross.  In a piece the symbols form a doubly linked
list; a heap holds the pairs that may merge, lowest rank first, then leftmost.
An entry whose symbols have changed since it was pushed is stale and skipped.
Decoding concatenates vocabulary strings and maps their letters back to bytes.

Cases: a null text is an empty one and has no tokens; very long pieces cost
n log n; repeated rows are encoded each; other columns are carried along.
"""

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tidemark.llm.words import released, widened

#: Fixed value: the public pattern that cuts text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers, as many again from before these, and the longest it does.
REMEMBERED, LONGEST = 300_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from U+0100 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printed else spare))
        spare += byte not in printed
    return letters


class Codec:
    """A byte-level BPE vocabulary, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.strings = {i: s for s, i in (vocab | special).items()}
        self.bytes = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
                      for i, s in self.strings.items()}
        self.first = [vocab[letter] for letter in letters]
        # A pair of ids in one number gives the merge's rank and new id in one: small numbers are quick to hash and compare.
        self.wide = max(vocab.values()).bit_length()
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << self.wide | vocab[right]] = rank << self.wide | vocab[left + right]
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        self.pattern = regex.compile(PATTERN)
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.special else [text]):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                ids.extend(self._pieces(self.pattern.findall(part)))
        return ids

    def _pieces(self, pieces: list[str]) -> Iterator[int]:
        known = self.remembered
        new = set(pieces).difference(known)
        if len(known) + len(new) > REMEMBERED:
            # What is in use comes over from the earlier ones; the rest goes with the next change.
            self.earlier, known = known, {}
            self.remembered, new = known, set(pieces)
        earlier = self.earlier
        for piece in new:
            ids = earlier.get(piece)
            known[piece] = self.merged(piece.encode()) if ids is None else ids
        found = chain.from_iterable([known[piece] for piece in pieces])
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        return found

    def forget(self) -> None:
        self.remembered, self.earlier = {}, {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        first, merges, wide = self.first, self.merges, self.wide
        ids = [first[b] for b in data]
        n = len(ids)
        # An entry is a merge and the place of its left symbol, in one number: lowest rank first, then leftmost.
        bits = n.bit_length()
        queue = [found << bits | k for k, pair in enumerate(zip(ids, ids[1:]))
                 if (found := merges.get(pair[0] << wide | pair[1])) is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        place, number = (1 << bits) - 1, (1 << wide) - 1
        while queue:
            entry = heapq.heappop(queue)
            left, merge = entry & place, entry >> bits
            right = after[left]
            # Stale: one of the two has been merged since.
            if right >= n or merges.get(ids[left] << wide | ids[right]) != merge:
                continue
            own = ids[left] = merge & number
            ids[right] = -1
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                if (found := merges.get(own << wide | ids[right])) is not None:
                    heapq.heappush(queue, found << bits | left)
            left = before[left]
            if left >= 0 and (found := merges.get(ids[left] << wide | own)) is not None:
                heapq.heappush(queue, found << bits | left)
        return tuple([i for i in ids if i >= 0])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def encode(documents: DataFrame, path: str, column: str = "text", into: str = "token_ids") -> DataFrame:
    """`documents` with the ids of each text."""
    source = documents.drop(into)
    schema = widened(source.schema, **{into: ArrayType(IntegerType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                ids = [own.encode(t or "") for t in texts.slice(start, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))],
                                                 [*rows.schema.names, into])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the text of each row's ids."""
    source = encoded.drop(into)
    schema = widened(source.schema, **{into: StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                lists = rows.column(rows.schema.get_field_index(ids)).to_pylist()
                texts = [None if x is None else own.decode(x) for x in lists]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())],
                                                 [*rows.schema.names, into])

    return source.mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str, column: str = "text", into: str = "token_ids",
               back: str = "decoded") -> DataFrame:
    """`documents` with the ids of each text and the text of the ids: `encode` and `decode` in one worker.

    What the worker remembers goes with the task.
    """
    source = documents.drop(into, back)
    schema = widened(source.schema, **{into: ArrayType(IntegerType()), back: StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                ids = [own.encode(t or "") for t in texts.slice(start, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())],
                    [*rows.schema.names, into, back])
        own.forget()
        released()

    return source.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text: both ways in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        number = {i: str(i) for i in own.strings}
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
