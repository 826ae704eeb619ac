"""WARC archives of pages, and a globally ordered index of their captures.

Each task writes one archive (a gzip member per record) in the order of URL key
and timestamp, and beside it a run: a file of its captures in blocks of Arrow.
What Spark carries of a run is one row per block, with its first and last key.

The index is an external merge of these runs.  Cuts between key ranges come from
the blocks' first keys; a task per range opens each run at the block where its
range begins and reads one block at a time, and a loser tree yields the captures
in order.  So a task holds a block per run, however large the range.  More runs
than `FAN_IN` are first merged to fewer, in passes.  The captures' places, and
the capture before each of the same URL, are told from that order alone.

Of records with equal payloads the one with the smallest page_id is a response
and the others revisit it.

Cases: a null or empty html is an empty payload; a null url has an empty key and
no target line; rows with the response's own page_id and payload are responses
too; a null page_id sorts first in the history, but is larger than any other when
the response is chosen, and payloads that only such rows have are responses; an
empty table gives no archive; other columns are not stored; line ends in a url
are percent-encoded; captures equal in key, time, page_id and payload follow each
other in the order of their files and offsets.
"""

import base64
import gzip
import hashlib
import io
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.files import new_file, reader, writer
from tidemark.llm.url_filter import host
from tidemark.session import work_dir, written

KEYS = ["url_key", "stamp", "page_id", "sha", "file", "offset"]
KEY = "url_key string, stamp string, page_id bigint, sha string, file string, offset bigint"
CAPTURE = f"{KEY}, length bigint, record_type string, refers_to bigint"
#: A block of a run: its file and number there, its captures and the keys of the first and the last.
BLOCKS = f"run int, path string, block int, n bigint, first struct<{KEY}>, last struct<{KEY}>"
#: Most captures of a block, and characters of URL keys after which it is full.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 18
#: Most runs that one task merges.
FAN_IN = 128
#: Captures of a key range, as long as there are no more ranges than the second; then ranges grow.
RANGE_ROWS, MAX_RANGES = 20_000, 10_000
#: Characters of a URL key that a cut keeps.  A longer key's captures fall on one side of it, whole.
CUT_CHARS = 1024

_KEY_FIELDS = [("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("sha", pa.string()),
               ("file", pa.string()), ("offset", pa.int64())]
_CAPTURE = pa.schema([*_KEY_FIELDS, ("length", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_BLOCKS = pa.schema([("run", pa.int32()), ("path", pa.string()), ("block", pa.int32()), ("n", pa.int64()),
                     ("first", pa.struct(_KEY_FIELDS)), ("last", pa.struct(_KEY_FIELDS))])


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the winner moves up.

    Of each sequence it holds the next item only.
    """

    def __init__(self, runs: Sequence[Iterable], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = max(1, len(runs))
        self.items = [None] * len(runs)
        self.heads = [self._head(r) for r in range(len(runs))]
        # Nodes 1 to size - 1 are matches, size to 2 size - 1 the runs.
        winners = [0] * self.size + list(range(self.size))
        self.losers = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _head(self, run: int):
        """The key of a run's next item; None when it has ended, which loses against all."""
        for item in self.runs[run]:
            self.items[run] = item
            return self.key(item)
        return None

    def _before(self, a: int, b: int) -> bool:
        first, second = self.heads[a], self.heads[b]
        if first is None or second is None:
            return first is not None
        return (first, a) < (second, b)

    def __iter__(self) -> Iterator:
        while self.heads and self.heads[self.winner] is not None:
            run = self.winner
            yield self.items[run]
            self.heads[run] = self._head(run)
            node = (run + self.size) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


# --- what is captured -------------------------------------------------------


def url_key(url: Column) -> Column:
    """The URL with its host's labels reversed, so that a domain's pages lie together."""
    labels = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    rest = F.regexp_extract(url, r"^.*?://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(labels, F.lit(")"), F.lower(rest)), F.lit(""))


def stamp(page_id: Column) -> Column:
    """A 14-digit time for tables that have none: page_id seconds after the start of 2024, within ten years."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(315_360_000)) + 1_704_067_200
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")


def decided(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with the page each row revisits, or null."""
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    firsts = narrow.where(F.col("n") >= at_least).groupBy("sha").agg(F.min("page_id").alias("first_page"))
    marks = (
        narrow.select("page_id", "sha").distinct().join(firsts, "sha")
        .where("first_page IS NOT NULL AND first_page IS DISTINCT FROM page_id").select(F.col("page_id").alias("marked"), F.col("sha").alias("marked_sha"), "first_page")
    )
    rows = pages.select("page_id", "url", "html").withColumn("sha", F.sha1(payload))
    same = rows["page_id"].eqNullSafe(marks["marked"]) & (rows["sha"] == marks["marked_sha"])
    return rows.join(marks, same, "left").select(
        "page_id", "url", "html", "sha", url_key(F.col("url")).alias("url_key"), stamp(F.col("page_id")).alias("stamp"),
        F.col("first_page").alias("refers_to"))


# --- records ----------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: dict) -> bytes:
    """One WARC record; a revisit has the response's HTTP header, but no payload."""
    payload = (page["html"] or "").encode()
    revisit = page["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    t = page["stamp"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page['page_id'] is None else page['page_id']}>",
             f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z"]
    if page["url"] is not None:
        target = page["url"].replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {target}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{page['refers_to']}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's page_id, payload_bytes, payload_digest, record_type and refers_to; payloads are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if fields["WARC-Type"] == "response" and (digest(payload) != told or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} has a payload that differs from its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "<urn:page:>").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": told,
            "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To")}


# --- archives and runs ------------------------------------------------------


class RunWriter:
    """Writes sorted captures to a file, opened at the first, and tells its blocks."""

    def __init__(self, folder: str, run: int, block_rows: int = BLOCK_ROWS):
        self.folder, self.run, self.block_rows = folder, run, block_rows
        self.path, self.out, self.file = None, None, None
        self.rows, self.chars, self.count = [], 0, 0

    def add(self, row: tuple) -> list[dict]:
        """Take a capture; gives the block that it filled, if any."""
        self.rows.append(row)
        self.chars += len(row[0])
        return self._block() if len(self.rows) >= self.block_rows or self.chars >= BLOCK_CHARS else []

    def close(self) -> list[dict]:
        last = self._block() if self.rows else []
        if self.file:
            self.file.close()
            self.out.close()
        return last

    def _block(self) -> list[dict]:
        if self.file is None:
            self.path = new_file(self.folder, ".run")
            self.out = writer(self.path)
            self.file = pa.ipc.new_file(self.out, _CAPTURE)
        self.file.write_batch(_batch(self.rows, _CAPTURE))
        first, last = (dict(zip(KEYS, row)) for row in (self.rows[0], self.rows[-1]))
        told = {"run": self.run, "path": self.path, "block": self.count, "n": len(self.rows), "first": first, "last": last}
        self.rows, self.chars, self.count = [], 0, self.count + 1
        return [told]


def write(pages: DataFrame, folder: str, at_least: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write archives and runs below `folder`; gives the runs' blocks (`BLOCKS`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name, out = 0, None, None
        captures = RunWriter(f"{folder}/runs", TaskContext.get().partitionId(), block_rows)
        for batch in batches:
            blocks = []
            for k in range(batch.num_rows):
                page = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                if out is None:
                    name = new_file(folder, ".warc.gz")
                    out = writer(name)
                data = gzip.compress(record(page), 6, mtime=0)
                out.write(data)
                kind = "response" if page["refers_to"] is None else "revisit"
                blocks += captures.add((page["url_key"], page["stamp"], page["page_id"], page["sha"], name, at, len(data),
                                        kind, page["refers_to"]))
                at += len(data)
            yield pa.RecordBatch.from_pylist(blocks, _BLOCKS)
        yield pa.RecordBatch.from_pylist(captures.close(), _BLOCKS)
        if out:
            out.close()

    ordered = decided(pages, at_least).sortWithinPartitions("url_key", "stamp", "page_id", "sha")
    return written(ordered.mapInArrow(run, BLOCKS), "runs")


# --- the merge --------------------------------------------------------------


def merged(runs: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: all captures of `runs`, with their place in the history and the capture before of the same URL.

    `place` counts from 0 in the order of `KEYS` over everything; `previous` is the page_id of the capture
    just before of the same url_key, null where there is none or it has none.
    """
    spark = runs.sparkSession
    while (runs.agg(F.max("run")).first()[0] or 0) >= fan_in:
        runs = _fewer(runs, fan_in, work_dir(spark, "merged-runs"), block_rows)
    captures = written(_in_ranges(runs, _cuts(runs, range_rows)), "history")
    # A row per range, so at most MAX_RANGES: its captures' places begin after those of the ranges before.
    ends = captures.groupBy("part").agg(
        F.count("*").alias("n"), F.max_by(F.struct("url_key", "page_id"), "at").alias("end"))
    order = Window.orderBy("part")
    ranges = ends.select(
        "part", (F.sum("n").over(order) - F.col("n")).alias("before"), F.lag("end").over(order).alias("end_before"))
    carried = (F.col("at") == 0) & (F.col("end_before.url_key") == F.col("url_key"))
    return captures.join(ranges, "part").select(
        *_CAPTURE.names, (F.col("before") + F.col("at")).alias("place"),
        F.when(carried, F.col("end_before.page_id")).otherwise(F.col("previous")).alias("previous"))


def order(row: Sequence) -> tuple:
    """What captures are ordered by, from a row that begins with `KEYS`."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4], row[5]


def _fewer(runs: DataFrame, fan_in: int, folder: str, block_rows: int) -> DataFrame:
    """One pass: each `fan_in` runs become one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cursors in _parts(batches, []):
            out = RunWriter(folder, part, block_rows)
            for _, row in LoserTree(cursors, _by_key):
                if blocks := out.add(row):
                    yield pa.RecordBatch.from_pylist(blocks, _BLOCKS)
            yield pa.RecordBatch.from_pylist(out.close(), _BLOCKS)

    groups = runs.agg(F.max("run")).first()[0] // fan_in + 1
    dealt = runs.select(F.floor(F.col("run") / fan_in).cast("int").alias("part"), "run", "path", "block")
    return written(_spread(dealt, groups).mapInArrow(run, BLOCKS), "runs")


def _cuts(runs: DataFrame, range_rows: int) -> list[tuple]:
    """Keys that part the captures into ranges of some `range_rows`, at most `MAX_RANGES`."""
    many = min(MAX_RANGES, (runs.agg(F.sum("n")).first()[0] or 0) // range_rows)
    if many < 2:
        return []
    keys = runs.select("first.*").withColumn("url_key", F.substring("url_key", 1, CUT_CHARS))
    firsts = keys.repartitionByRange(many, *KEYS).withColumn("part", F.spark_partition_id())
    found = firsts.groupBy("part").agg(F.min(F.struct(*KEYS)).alias("cut")).collect()
    return sorted({order(row["cut"]) for row in found})[1:]


def _in_ranges(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Captures merged range by range, with the range (`part`), place there (`at`) and `previous` in it."""
    shared = runs.sparkSession.sparkContext.broadcast(cuts)
    added = [("part", pa.int32()), ("at", pa.int64()), ("previous", pa.int64())]
    schema = pa.schema([*_CAPTURE, *added])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                low, high = (bisect_right(shared.value, order([b[end][k] for k in KEYS])) for end in ("first", "last"))
                rows += [{"part": p, "run": b["run"], "path": b["path"], "block": b["block"]} for p in range(low, high + 1)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), *[_BLOCKS.field(k) for k in range(3)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cursors in _parts(batches, shared.value):
            some, last = [], None
            for at, (_, row) in enumerate(LoserTree(cursors, _by_key)):
                before = last[2] if last and last[0] == row[0] else None
                some.append((*row, part, at, before))
                last = row
                if len(some) == 4096:
                    yield _batch(some, schema)
                    some = []
            if some:
                yield _batch(some, schema)

    dealt = runs.mapInArrow(deal, "part int, run int, path string, block int")
    return _spread(dealt, len(cuts) + 1).mapInArrow(run, f"{CAPTURE}, part int, at bigint, previous bigint")


def _spread(dealt: DataFrame, parts: int) -> DataFrame:
    """For each part, in a partition of its own, the stretch of blocks it reads of each run."""
    stretches = dealt.groupBy("part", "run", "path").agg(F.min("block").alias("start"), F.max("block").alias("end"))
    return stretches.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "run")


def _parts(batches: Iterator[pa.RecordBatch], cuts: list[tuple]) -> Iterator[tuple[int, list[Iterator]]]:
    """Each part of a partition, with a cursor over each of its runs."""
    stretches = (row for batch in batches for row in batch.to_pylist())
    for part, own in groupby(stretches, lambda row: row["part"]):
        low = cuts[part - 1] if cuts and part else None
        high = cuts[part] if part < len(cuts) else None
        yield part, [_cursor(row["path"], row["start"], row["end"], low, high) for row in own]


def _cursor(path: str, start: int, end: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's captures from key `low` on and below `high`, one block in memory."""
    with reader(path) as file, pa.ipc.open_file(file) as blocks:
        for k in range(start, end + 1):
            for row in zip(*[c.to_pylist() for c in blocks.get_batch(k).columns]):
                key = order(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, row


def _by_key(item: tuple) -> tuple:
    return item[0]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The records that an index points to, read from the archives, with `place` and `previous` from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            found = []
            for path, offset, length, place, previous in zip(*[c.to_pylist() for c in batch.columns]):
                if path != name:
                    name, file = path, reader(path)
                file.seek(offset)
                with gzip.GzipFile(fileobj=io.BytesIO(file.read(length))) as member:
                    found.append({**parsed(member.read()), "place": place, "previous": previous})
            yield pa.RecordBatch.from_pylist(found, pa.schema([
                ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("record_type", pa.string()), ("refers_to", pa.int64()), ("place", pa.int64()), ("previous", pa.int64())]))

    # A number of its own: the rows are few bytes, but what they point to is not.
    files = max(1, index.select("file").distinct().count())
    picked = index.select("file", "offset", "length", "place", "previous")
    spread = picked.repartition(files, "file").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                  "refers_to bigint, place bigint, previous bigint")
