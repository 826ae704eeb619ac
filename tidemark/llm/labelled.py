"""What both classifiers share: the labelled rows they may learn from, and how they score."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import pieces


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the folds; a null id is in none."""
    return F.crc32(doc_id.cast("string")) % folds


def training(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the rows to learn from; a document with several labels has the largest."""
    own = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return own.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` of the labels, chosen by a hash of doc_id."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, or the same with lines under it if a column has it already."""
    while name.lower() in [c.lower() for c in taken]:
        name += "_"
    return name


def with_score(documents: DataFrame, model, score: Callable, into: str = "score") -> DataFrame:
    """`documents` with a column `into` of `score(model, bytes, offsets)`.

    Only the texts go to Python and only scores come back.  A column of the name
    `into` is replaced; `fresh` gives a name that is free.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            batch = pa.RecordBatch.from_arrays([text], ["text"])
            found = [pa.array(score(shared.value, data, offsets), pa.float64()) for _, data, offsets in pieces([batch], "text")]
            yield pa.concat_arrays(found) if found else pa.array([], pa.float64())

    return documents.drop(into).withColumn(into, scores("text"))
