"""Spelling variants: words one edit apart, by dense prefix-suffix tiles.

Two words of longer length M are a single edit apart if what they share at the front
and what they share at the end come to at least M - 1 code points.  One of the two
shares is then at least M div 2 long.  So every word is filed under its first and
under its last M div 2 code points, for M its own length and one more; words that
meet nowhere need no comparison.

A group's words become rows of a padded matrix of code points, and blocks of rows are
compared pair by pair, all cells at once: shared prefixes from the matrix aligned to
the left, shared suffixes from the one aligned to the right.  A pair that meets in
both groups counts in the prefix group only.  A group of more than TILE words is dealt
into parts by hash, and each pair of parts is a tile of its own, so no task holds more
than two parts of a group and no list of pairs is written but those found.

A word's form is its near word of largest n if that is at least `RATIO` times its own;
as n at least doubles, forms lead to a root in a few steps, found by doubling.

Cases: null and empty texts have no words; a null doc_id counts as an empty one in the
hash; documents that repeat count each time; words of any length are compared, with
smaller blocks for long ones; ties go to the smallest word in code-point order; no
documents give no rows; other columns are ignored.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import LOWER, released
from tidemark.session import written

LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILED = 5, 3, 2, 97
#: Words of a group that one tile compares with as many others.
TILE = 512
#: Words compared with words at once; fewer where this many letters are more.
BLOCK, CELLS = 128, 1 << 22
#: Words a worker counts before it passes them on.
HELD = 200_000
#: Fixed value: runs of [a-zÀ-ÿ] in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
GROUP = ["size", "side", "part", "low", "high"]


# --- words ------------------------------------------------------------------


def occurrences(doc_id: int | None, text: str | None, spoiled: int = SPOILED) -> Counter:
    """The words of a document, in UTF-8, with how often each occurs.

    A run whose hash with doc_id is divisible by `spoiled` loses one code point.
    """
    found: Counter = Counter()
    start = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    start = zlib.crc32(b":", start)
    for run, n in Counter(RUN.findall((text or "").encode().translate(LOWER.tobytes()))).items():
        h = zlib.crc32(run, start)
        if h % spoiled == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1:]).encode()
        found[run] += n
    return found


def words(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words long and frequent enough."""
    def rows(held: Counter) -> pa.RecordBatch:
        # Code points: bytes less the second bytes of two.
        kept = [(w.decode(), n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= least_length]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(occurrences(doc_id.as_py(), text.as_py()))
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)
        held.clear()
        released()

    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- pairs ------------------------------------------------------------------


def tiles(listed: DataFrame, tile: int = TILE) -> DataFrame:
    """The words under each group they belong to, and there under each tile."""
    length = F.length("word")
    filed = []
    for size in (length, length + 1):
        share = F.floor(size / 2).cast("int")
        for side, part in ((0, F.left("word", share)), (1, F.right("word", share))):
            filed.append(F.struct(size.alias("size"), F.lit(side).alias("side"), part.alias("part")))
    keyed = listed.select(F.inline(F.array(*filed)), "word", "n")
    key = GROUP[:3]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("many")).where("many > 1")
    sizes = sizes.select(*key, F.ceil(F.col("many") / tile).cast("int").alias("parts"))
    own = keyed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    others = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return others.select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n")


class Matrix:
    """Words as columns of code points, from the left and from the right.

    Padding is 0, which no letter is; two words that differ meet a letter before
    their paddings could match.
    """

    def __init__(self, texts: pa.Array):
        data = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        self.lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
        self.width = int(self.lengths.max(initial=0))
        kind = np.uint8 if not len(data) or data.max() < 256 else np.uint32
        column = np.arange(self.width)
        left, right = np.zeros((2, len(texts), self.width), kind)
        left[column < self.lengths[:, None]] = data
        right[column >= self.width - self.lengths[:, None]] = data
        # A letter of all words after the other; the right one backwards.
        self.left, self.right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T[::-1])

    def shared(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the shared prefix and suffix of each word of `a` with each of `b`."""
        # No tile is wider than its longest word.
        width = int(max(self.lengths[a].max(), self.lengths[b].max()))
        return _run(self.left[:width, a], self.left[:width, b]), _run(self.right[:width, a], self.right[:width, b])


def _run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters of each word in `a` and each in `b` are the same, up to the first that is not."""
    same = np.ones((a.shape[1], b.shape[1]), bool)
    length = np.zeros(same.shape, np.int16 if len(a) < 2 ** 15 else np.int64)
    for x, y in zip(a, b):
        same &= x[:, None] == y
        length += same
    return length


def _near_in(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of near words (row numbers) in whole tiles, which follow each other."""
    columns = {name: rows[name].combine_chunks().to_numpy() for name in ("size", "side", "low", "high", "own")}
    new = _begins(rows)
    tile = np.cumsum(new)
    matrix = Matrix(rows["word"].combine_chunks())
    lengths, size, side = matrix.lengths, columns["size"], columns["side"]
    apart, own = columns["low"] != columns["high"], columns["own"]
    step = max(1, min(BLOCK, isqrt(CELLS // max(1, matrix.width))))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(tile), step):
        a = slice(i, min(i + step, len(tile)))
        for j in range(i, len(tile), step):
            # Blocks of later tiles have nothing to do with this one.
            if tile[j] > tile[a.stop - 1]:
                break
            b = slice(j, min(j + step, len(tile)))
            prefix, suffix = matrix.shared(a, b)
            longer = np.maximum(lengths[a, None], lengths[None, b])
            fits = (prefix + suffix >= longer - 1) & (tile[a, None] == tile[None, b]) & (longer == size[a, None])
            fits &= np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)[None, :]
            # Between two parts only; and what the prefix group finds, the suffix group leaves.
            fits &= ~apart[a, None] | (own[a, None] != own[None, b])
            fits &= (side[a, None] == 0) | (prefix < longer // 2)
            x, y = np.nonzero(fits)
            found.append((x + i, y + j))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _begins(rows: pa.Table) -> np.ndarray:
    """Which rows begin a new tile."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = False
        for name in GROUP:
            column = rows[name].combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


def pairs(listed: DataFrame, tile: int = TILE) -> DataFrame:
    """word, near, near_n: each two words one edit apart, both ways."""
    dealt = tiles(listed, tile)
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)

    def output(rows: pa.Table) -> pa.RecordBatch:
        x, y = _near_in(rows)
        text, n = rows["word"].combine_chunks(), rows["n"].combine_chunks()
        a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
        return pa.RecordBatch.from_arrays([text.take(a), text.take(b), n.take(b)], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            # The last tile may go on in the next batch; a tile has some 2 * TILE rows.
            begins = np.flatnonzero(_begins(held))
            if begins[-1]:
                yield output(held.slice(0, int(begins[-1])).combine_chunks())
                held = held.slice(int(begins[-1]))
        if held is not None and held.num_rows:
            yield output(held.combine_chunks())
        held = None
        released()

    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


# --- forms ------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead to, by doubling."""
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = step.join(further, "root", "left")
        done = longer.where("next IS NOT NULL").isEmpty()
        if done:
            return step
        step = written(longer.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(documents: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word."""
    listed = written(words(documents), "words")
    # The largest n; of equal ones the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs(listed, tile).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = listed.join(near, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = written(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
