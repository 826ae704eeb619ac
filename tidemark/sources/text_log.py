"""Text change logs: one tab-separated record per line, flag first, tag last.

Epochs come either from marker lines inside the text or from ``epoch=N``
folders.  Both give lines ``(epoch, seq, value)`` or ``(epoch, value)``, which
`parse` splits into records.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.columns import flag_of, format_day, parse_day, weight_of
from tidemark.schemas import DAY, TABLES, TEXT
from tidemark.session import written

# Control lines and the field separator of the format.
EPOCH_END = "Bye"
FILE_END = "End"
TAB = "\t"

# Lines summarised in one row: a power of two, as a bucket is a line's place shifted.
BUCKET_BITS = 12


# --- lines and epochs -------------------------------------------------------


def with_position(raw: DataFrame) -> DataFrame:
    """Text lines with the file split they came from; works on streams too."""
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def summarize_splits(lines: DataFrame, first_epoch: int = 0, first_seq: int = 0) -> DataFrame:
    """One row per bucket of consecutive lines of a file split: the epoch and line number it starts with, its markers.

    A bucket has at most 4096 lines, so its list of markers is short however
    many a split has.  Written to the work folder and read back, as both the
    lines and a following stream batch need it.
    """
    summary = lines.withColumn("at", _place()).groupBy("file", "block", _bucket().alias("bucket")).agg(
        F.min("at").alias("start"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("value") == EPOCH_END, F.col("at")))).alias("marks"),
    )
    buckets = written(summary, "buckets")
    counts = {"n": F.sum("n"), "m": F.sum(F.size("marks"))}
    splits = buckets.groupBy("file", "block").agg(*[total.alias(f"split_{k}") for k, total in counts.items()])
    # Prefix sums in two levels: over the splits, one row each, and over the buckets of each split.
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", *[
        F.coalesce(F.sum(f"split_{k}").over(earlier), F.lit(0)).alias(f"{k}_before") for k in counts])
    inside = Window.partitionBy("file", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = {k: F.coalesce(total.over(inside), F.lit(0)) for k, total in counts.items()}
    return written(buckets.withColumns({f"{k}_within": c for k, c in within.items()}).join(splits, ["file", "block"]).select(
        "file", "block", "bucket", "start", "marks", "n",
        (F.col("n_before") + F.col("n_within") + first_seq).alias("seq0"),
        (F.col("m_before") + F.col("m_within") + first_epoch).alias("epoch0"),
    ), "splits")


def number_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Give each line of `with_position` its epoch and its line number.

    Spark brings the summary to the lines while it is small, by its own size
    check, and shuffles both beyond.
    """
    passed = F.size(F.filter("marks", lambda mark: mark < F.col("at")))
    # Both passes must have cut the files alike, or a line would miss its bucket.
    same_cut = F.col("start").isNotNull()
    epoch = (
        F.when(~same_cut, F.raise_error("the split size changed between two passes").cast("bigint"))
        .when(F.size("marks") == 0, F.col("epoch0"))
        .otherwise(F.col("epoch0") + passed)
    )
    placed = lines.withColumn("at", _place()).withColumn("bucket", _bucket()).join(splits, ["file", "block", "bucket"], "left")
    return placed.select(
        epoch.cast("int").alias("epoch"),
        (F.col("seq0") + F.col("at") - F.col("start")).alias("seq"),
        "value",
    )


def _bucket() -> Column:
    return F.shiftright("at", BUCKET_BITS)


def _place() -> Column:
    # Rises along each split, as a task reads its splits from top to bottom.
    return F.monotonically_increasing_id()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Data lines ``(epoch, seq, value)`` of a log with epoch markers.

    `path` is one file or a folder; the files of a folder follow each other in
    the order of their paths.  A file may have any size, it is read in splits.
    """
    lines = with_position(spark.read.text(path))
    return data_lines(number_lines(lines, summarize_splits(lines)))


def read_epoch_folders(spark: SparkSession, path: str) -> DataFrame:
    """Data lines ``(epoch, value)`` of a log kept as ``path/epoch=N/*``."""
    raw = spark.read.schema("value string, epoch int").text(path)
    return data_lines(raw.select("epoch", "value"))


def stream_epoch_folders(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """`read_epoch_folders` as a stream that takes up new files as they come."""
    reader = spark.readStream.schema("value string, epoch int")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return data_lines(reader.text(path).select("epoch", "value"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no control lines."""
    return lines.where(~F.col("value").isin(EPOCH_END, FILE_END))


# --- records ----------------------------------------------------------------


def parse(lines: DataFrame) -> DataFrame:
    """Lines to records: the fields ``f`` as text, the ``tag`` and the weight ``w``.

    The columns of the lines stay.  Nothing is judged yet: `table_changes`,
    `quarantine` and `routed` pick from the records what they need.
    """
    # Exploding a one-element array splits each line once; as a plain column
    # the split would be copied into every filter and cast above it.
    fields = F.split(F.rtrim("value", F.lit(TAB)), TAB)
    return lines.select("*", F.explode(F.array(fields)).alias("f")).select(
        "*",
        F.element_at("f", -1).alias("tag"),
        weight_of(F.get("f", F.lit(0))).alias("w"),
    )


def _typed(tag: str) -> list[Column]:
    """The fields of a table's record in its types; NULL for what does not fit."""
    columns = []
    for i, field in enumerate(TABLES[tag], start=1):
        text = F.get("f", F.lit(i))
        value = parse_day(text) if field.dataType == DAY else text.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return columns


def _full(tag: str) -> Column:
    """Whether a record has as many fields as the table's columns, flag and tag."""
    return F.size("f") == len(TABLES[tag]) + 2


def _fits(tag: str, columns: list[Column] | None = None) -> Column:
    """Whether every field that is no text has a value of its type."""
    fits = F.lit(True)
    for field, column in zip(TABLES[tag], columns or _typed(tag)):
        if field.dataType != TEXT:
            fits = fits & column.isNotNull()
    return fits


def is_good(tag: str) -> Column:
    """Whether a record is a usable change of the table."""
    return (F.col("tag") == tag) & _full(tag) & F.col("w").isNotNull() & _fits(tag)


def reason(typed: dict[str, list[Column]] | None = None) -> Column:
    """Why a record cannot be used; NULL if it can."""
    why = F.when(~F.col("tag").isin(*TABLES), "unknown table")
    for tag in TABLES:
        why = why.when((F.col("tag") == tag) & ~_full(tag), "field count")
    why = why.when(F.col("w").isNull(), "change flag")
    for tag in TABLES:
        why = why.when((F.col("tag") == tag) & ~_fits(tag, (typed or {}).get(tag)), "bad value")
    return why


def _kept(records: DataFrame) -> list[str]:
    return [c for c in ("epoch", "seq") if c in records.columns]


def table_changes(records: DataFrame, tag: str, on_unknown: str = "quarantine") -> DataFrame:
    """The typed change log of one table: ``w, epoch[, seq]``, then its own columns.

    With ``fail`` for `on_unknown` a record of an unknown table stops the job.
    """
    good = F.when(_unknown(on_unknown), is_good(tag))
    return records.where(good).select("w", *_kept(records), *_typed(tag))


def _unknown(policy: str) -> Column:
    """True for every record; ``fail`` raises at one of an unknown table."""
    if policy not in ("quarantine", "drop", "fail"):
        raise ValueError(f"on_unknown: {policy}")
    if policy != "fail":
        return F.lit(True)
    stop = F.raise_error(F.concat(F.lit("unknown table: "), F.coalesce("tag", F.lit("")))).cast("boolean")
    return F.when(F.coalesce(F.col("tag").isin(*TABLES), F.lit(False)), True).otherwise(stop)


def quarantine(records: DataFrame, on_unknown: str = "quarantine") -> DataFrame:
    """Records that could not be used, with the reason and their text.

    `on_unknown` says what an unknown table tag means: ``quarantine`` lists it
    here, ``drop`` leaves it out, ``fail`` stops the job.
    """
    bad = records.where(_unknown(on_unknown)).select(*_kept(records), "tag", reason().alias("reason"), "value")
    bad = bad.where(F.col("reason").isNotNull())
    return bad.where(F.col("reason") != "unknown table") if on_unknown == "drop" else bad


def routed(records: DataFrame, on_unknown: str = "quarantine") -> DataFrame:
    """All records in one shape: a struct per table, filled for the record's own.

    Bad records get the tag ``quarantine``, their reason and their text;
    `on_unknown` is as in `quarantine`.
    """
    records = records.where(_unknown(on_unknown))
    if on_unknown == "drop":
        records = records.where(F.col("tag").isin(*TABLES))
    whole = {tag: (F.col("tag") == tag) & _full(tag) for tag in TABLES}
    typed = records.select("*", *[F.when(whole[tag], F.struct(*_typed(tag))).alias(tag) for tag in TABLES])
    values = {tag: [F.col(f"{tag}.{name}") for name in TABLES[tag].names] for tag in TABLES}
    judged = typed.withColumn("reason", reason(values))
    good = F.col("reason").isNull()
    return judged.select(
        "w", *_kept(records),
        *[F.when(good, F.col(tag)).alias(tag) for tag in TABLES],
        "reason",
        F.when(~good, F.col("value")).alias("value"),
        F.when(good, F.col("tag")).otherwise("quarantine").alias("tag"),
    )


# --- writing ----------------------------------------------------------------


def to_lines(log: DataFrame, tag: str) -> DataFrame:
    """A table's change log as text lines ``(epoch, value)``.

    Columns the log lacks become empty text, or zero or its own day where a
    number or a date is needed.
    """
    fields = [flag_of(F.col("w"))]
    days = [f.name for f in TABLES[tag] if f.name in log.columns and f.dataType == DAY]
    for field in TABLES[tag]:
        if field.name in log.columns:
            value = F.col(field.name).cast(field.dataType)
            text = format_day(value) if field.dataType == DAY else value.cast("string")
        elif field.dataType == DAY:
            text = format_day(F.col(days[0]).cast("date"))
        else:
            text = F.lit("" if field.dataType == TEXT else "0")
        fields.append(text)
    return log.select("epoch", F.concat_ws(TAB, *fields, F.lit(tag)).alias("value"))


def write_marked(lines: DataFrame, path: str, epoch: int) -> None:
    """Write one epoch's lines and its end marker into the log folder `path`.

    The files of a log follow each other in name order, so an epoch gets a
    numbered folder in which the marker's file comes after the data.
    """
    folder = f"{path}/at={epoch:08d}"
    lines.select("value").write.mode("overwrite").text(f"{folder}/part=0")
    mark = lines.sparkSession.range(1).select(F.lit(EPOCH_END).alias("value"))
    mark.write.mode("overwrite").text(f"{folder}/part=1")
