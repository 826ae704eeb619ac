"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised; at cosine c two lie sqrt(2 - 2 c) apart.  A table's hash
is `k` Gaussian projections, shifted and cut into steps of WIDTH.  k grows with the
logarithm of the rows, so unrelated vectors meet in a bucket about once, and there
are as many tables as a pair right at the threshold needs to meet with RECALL.

Equal vectors are one class with a weight.  A bucket larger than BLOCK is split
into blocks, and each pair of blocks is a task's group of its own.  A group gives
one row per member: its links, and the smallest member it reaches within the group.
A pair that meets in several tables counts in the first.

Cases: a vector that is null, empty or zero, or holds null or non-finite numbers,
links with nothing, and so does a row without vec_id; vectors of other lengths
never meet; repeated rows count as vectors of their own, a vec_id has one vector;
an empty table gives no rows; other columns are ignored.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.words import mix
from tidemark.session import written

WIDTH, RECALL, SEED = 2.2, 0.995, 20_240_101
#: Most members compared at once; larger buckets are split.
BLOCK = 1_000
_SMALL = 48
_U = np.uint64


def meeting(distance: float) -> float:
    """The chance that one projection puts two vectors so far apart into one step."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(rows: int, threshold: float) -> tuple[int, int]:
    """Projections in a table, and tables."""
    near, far = meeting(math.sqrt(2 - 2 * threshold)), meeting(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near ** k))


@lru_cache(maxsize=8)
def _projections(dims: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64([SEED, dims]))
    return random.standard_normal((dims, k * tables)), random.random(k * tables) * WIDTH


def buckets(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    directions, shift = _projections(unit.shape[1], k, tables)
    steps = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(_U).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        total = np.arange(tables, dtype=_U) + _U(unit.shape[1] << 32)
        for j in range(k):
            total = mix(total * _U(0xD1342543DE82EF95) + steps[:, :, j])
    return total.view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the vectors of each length, and those as a matrix."""
    lengths = lists.value_lengths().to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)


def usable(embedding: str):
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _hashed(groups: DataFrame, k: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                rows = batch.slice(low, 1024)
                for at, vectors in _by_length(rows.column(1)):
                    found = buckets(_unit(vectors), k, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(rows.column(0).to_numpy()[at], tables)), pa.array(found.ravel())], ["id", "bucket"])

    return groups.select("id", "embedding").mapInArrow(run, "id bigint, bucket bigint")


def _grouped(hashed: DataFrame) -> DataFrame:
    """id, bucket, part, low, high: the groups that each member of a shared bucket belongs to."""
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    members = hashed.join(sizes, "bucket").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return members.withColumn("other", other).select(
        "id", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def _compared(groups: DataFrame, threshold: float, k: int, tables: int) -> DataFrame:
    """id, n_links, root: of each member that has a link in some group, by group."""
    def pairs(part: np.ndarray, first: int, split: bool) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(part), 1)
        if split:
            apart = part[i] != part[j]
            i, j = i[apart], j[apart]
        return i + first, j + first

    def result(ids, weight, unit, bucket, group, i, j) -> pa.RecordBatch:
        cosine = np.concatenate([(unit[i[a:a + 65536]] * unit[j[a:a + 65536]]).sum(1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        near = cosine >= threshold
        i, j = i[near], j[near]
        used = np.unique(np.concatenate([i, j]))
        if len(used):
            # A pair belongs to the first table in which its buckets are equal.
            own = buckets(unit[used], k, tables)
            fresh = np.ones(len(i), bool)
            place = np.searchsorted(used, i), np.searchsorted(used, j)
            for a in range(0, len(i), 16384):
                some = slice(a, a + 16384)
                equal = own[place[0][some]] == own[place[1][some]]
                first = equal.argmax(1)
                fresh[some] = own[place[0][some], first] == bucket[i[some]]
            links = np.bincount(np.concatenate([i[fresh], j[fresh]]), np.concatenate([weight[j[fresh]], weight[i[fresh]]]), len(ids))
            root = ids.copy()
            while True:
                least = root.copy()
                np.minimum.at(least, i, root[j])
                np.minimum.at(least, j, least[i])
                if (least == root).all():
                    break
                root = least
        else:
            links, root = np.zeros(len(ids)), ids
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[used]), pa.array(links[used].astype(np.int64)), pa.array(root[used])], ["id", "n_links", "root"])

    def table_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, weight, bucket, part, low, high = [batch.column(c).to_numpy() for c in range(6)]
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        ends = np.append(starts[1:], len(ids))
        found = []
        (_, vectors), = _by_length(batch.column(6))
        unit = _unit(vectors)
        for a, b in zip(starts, ends):
            if b - a > 1:
                found.append(pairs(part[a:b], a, low[a] != high[a]))
        i = np.concatenate([x for x, _ in found] or [np.zeros(0, int)])
        j = np.concatenate([y for _, y in found] or [np.zeros(0, int)])
        return result(ids, weight, unit, bucket, starts, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            bucket, low, high, size = [held.column(c).to_numpy() for c in (2, 4, 5, 7)]
            start = 0
            while True:
                # Whole groups of one vector length, some thousand members at a time.
                last = min(start + 4096, len(bucket) - 1)
                cut = _last_end(bucket, low, high, size, start, last)
                if cut is None:
                    break
                yield table_of(held.slice(start, cut - start))
                start = cut
            held = held.slice(start)
        if held is not None and held.num_rows:
            sizes = held.column(7).to_numpy()
            at = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1], [True]]))
            for a, b in zip(at[:-1], at[1:]):
                yield table_of(held.slice(a, b - a))

    return groups.mapInArrow(run, "id bigint, n_links bigint, root bigint")


def _last_end(bucket, low, high, size, start: int, last: int) -> int | None:
    """The end of the last group that surely ends within start..last; groups after a change of length wait."""
    change = np.flatnonzero((bucket[start + 1:last + 1] != bucket[start:last]) | (low[start + 1:last + 1] != low[start:last])
                            | (high[start + 1:last + 1] != high[start:last])) + start + 1
    if not len(change):
        # One group fills the span: look on for its end.
        after = np.flatnonzero((bucket[last:] != bucket[start]) | (low[last:] != low[start]) | (high[last:] != high[start]))
        return int(after[0]) + last if len(after) else None
    other = np.flatnonzero(size[start:last + 1] != size[start])
    if len(other):
        return int(other[0]) + start
    return int(change[-1])


def near_groups(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id of each row of `embeddings` (vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("usable", usable("embedding") & F.col("vec_id").isNotNull())
    groups = written(rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vectors")
    k, tables = shape(groups.count(), threshold)
    hashed = written(_hashed(groups, k, tables), "hashed")
    members = _grouped(hashed).join(groups, "id").select(
        "id", "weight", "bucket", "part", "low", "high", "embedding", F.size("embedding").alias("size"))
    order = ["bucket", "low", "high"]
    dealt = members.repartition(*order).sortWithinPartitions("size", *order)
    compared = written(_compared(dealt, threshold, k, tables), "compared")
    links = compared.groupBy("id").agg(F.sum("n_links").alias("links"))
    roots = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = (
        groups.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
        .select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("root", "id").alias("component_id"))
    )
    linked = rows.where("usable").join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)
