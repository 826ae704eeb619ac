"""Token ids as flat binary files with 64-bit document offsets.

Documents are sorted by id into range partitions.  Each partition is three flat
little-endian files: the ids (unsigned, 16 or 32 bits by the vocabulary's size),
the documents' offsets in it (64 bits, one more than documents), and the
documents' own ids (64 bits).  A manifest row names a partition's files; prefix
sums over the manifest give each partition's base, so document i of a partition
begins at base + offsets[i] of the whole.  Readers map the files into memory.

Cases: a null text is an empty one and holds only the end id; a null doc_id sorts
first and is stored as the smallest 64-bit number, and the manifest tells how many
of a partition's first documents have none, so that number itself is an id like any
other; equal doc_ids keep one row each, ordered by text; an empty table has an empty
manifest; other columns are not stored.
"""

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidemark.llm.files import mapped, new_file, writer
from tidemark.llm.words import pieces

#: Words a worker remembers, and the longest it does.
REMEMBERED, LONGEST = 1_000_000, 64
_MARK = re.compile(r"([.,])(?<=[a-z0-9\xdf-\xf6\xf8-\xff][.,])(?=[ \n])")
NULL_ID = -(1 << 63)
MANIFEST = ("part int, ids_file string, offsets_file string, docs_file string, width int, n_docs bigint, "
            "n_null bigint, n_tokens bigint")
# The steps of a tokenizer file under which a text's words may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Encoder:
    """A tokenizer of the tokenizers library that remembers the words it has met.

    That is for files of the steps above: their pre-tokens never hold white space and
    normalisation never reaches across it, so a text's ids are those of its parts between
    spaces or line ends.  Under any other file texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = wordwise(steps)
        suffix = steps["model"].get("end_of_word_suffix") or "\0"
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.remembered: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of a flat array."""
        if not self.by_words:
            return [self._bytes(found) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self._words(text) for text in texts]
        known = self.remembered
        if new := {w for words in cut for w in words if w not in known}:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {w for words in cut for w in words}
            self._learn(list(new))
        found = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return found

    @staticmethod
    def _words(text: str) -> list[str]:
        """Parts that may be encoded one by one."""
        if "<|" not in text and _latin(text):
            # Normalisation makes these texts lower case and does no more; a mark after a letter is a pre-token.
            text = _MARK.sub(r" \1", text.lower())
        return text.replace("\n", " ").split(" ")

    def _learn(self, words: list[str]) -> None:
        known = self.remembered
        # A word of letters is one pre-token, whose last id says that it ends.
        letters = [w for w in words if w.isalpha() and _latin(w)]
        ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, self.dtype)
        ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
        if len(ends) == len(letters):
            for word, low, high in zip(letters, [0, *ends], ends):
                known[word] = ids[low:high].tobytes()
            words = [w for w in words if w not in known]
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            known[word] = self._bytes(found)

    def _bytes(self, found) -> bytes:
        return np.array(found.ids, self.dtype).tobytes()


def wordwise(steps: dict) -> bool:
    """Whether a tokenizer file's steps are those that `Encoder` may follow word by word."""
    plain = all("<|" in t["content"] and not any(c.isspace() for c in t["content"])
                and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in steps["added_tokens"])
    return plain and steps["normalizer"] == NORMALIZER and steps["pre_tokenizer"] == PRE_TOKENIZER and not steps["model"].get("dropout")


def _latin(text: str) -> bool:
    """Whether a text holds no letter beyond U+00FF."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(documents: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Write the files of `documents` (doc_id, text) below `folder`; gives the manifest's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([end_id], own.dtype).tobytes()
        names = [new_file(folder, s) for s in (".ids", ".offsets", ".docs")]
        n_docs, n_null, n_tokens = 0, 0, 0
        with writer(names[0]) as ids, writer(names[1]) as offsets, writer(names[2]) as docs:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for rows, _, _ in pieces(batches, "text"):
                data = own.encode([text or "" for text in rows.column(1).to_pylist()])
                ids.write(end.join([*data, b""]))
                lengths = np.array([len(d) // own.width + 1 for d in data])
                offsets.write((n_tokens + np.cumsum(lengths)).astype("<i8").tobytes())
                docs.write(rows.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs += rows.num_rows
                n_null += rows.column(0).null_count
                n_tokens += int(lengths.sum())
        if n_docs:
            row = [TaskContext.get().partitionId(), *names, own.width, n_docs, n_null, n_tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), *[pa.string()] * 3, pa.int32(), *[pa.int64()] * 3))],
                ["part", "ids_file", "offsets_file", "docs_file", "width", "n_docs", "n_null", "n_tokens"])

    ranged = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(documents.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each partition's `first_doc` and `base`, the sums over the partitions before it.

    A row for each partition, so one task may hold them all.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.withColumns({
        "first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
        "base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)),
    })


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (in ids, of the whole), n_tokens, and token_ids or with `digest` their ids_crc32."""
    kind = "ids_crc32 bigint" if digest else "token_ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(row["ids_file"], f"<u{row['width']}")
                offsets, docs = mapped(row["offsets_file"], "<i8"), mapped(row["docs_file"], "<i8")
                for low in range(0, len(docs), 256):
                    at = offsets[low:low + 257]
                    doc_ids = np.asarray(docs[low:low + 256])
                    lists = [np.asarray(ids[a:b]).astype("<u4") for a, b in zip(at[:-1], at[1:])]
                    last = pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64()) if digest else pa.array(
                        [x.astype("i8") for x in lists], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, mask=np.arange(low, low + len(doc_ids)) < row["n_null"]), pa.array(row["base"] + at[:-1]),
                         pa.array(np.diff(at)), last],
                        ["doc_id", "start", "n_tokens", kind.split()[0]])

    rows = manifest(spark, folder)
    spread = rows.repartition(max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count()), "part")
    return spread.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")
