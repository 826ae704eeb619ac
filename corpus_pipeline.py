"""From documents to token ids: each stage works on what the one before kept."""

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, quality, toxicity
from tidemark.llm.labelled import fresh, training
from tidemark.llm.queries import QUALITY, TOXIC
from tidemark.llm.words import released
from tidemark.session import prepare, written


def _begun(spark: SparkSession) -> None:
    """The settings of a stage; the driver gives back what the stage before held."""
    prepare(spark)
    released()


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models score as toxic go."""
    _begun(spark)
    labels = training(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", folds=5, held_out=0)
    score = fresh("score", docs.columns)
    scored = toxicity.scored(docs, toxicity.train(docs, labels), score)
    return scored.where(scored[score] < TOXIC).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores as poor go."""
    _begun(spark)
    labels = training(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", folds=4, held_out=2)
    score = fresh("score", docs.columns)
    scored = quality.scored(docs, *quality.train(docs, labels), score)
    return scored.where(scored[score] >= QUALITY).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document of the smallest id stays."""
    _begun(spark)
    return jaccard.one_of_each(docs, jaccard.Rule(size=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    _begun(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text, and the text that they decode to; a null text has none and decodes to an empty one."""
    _begun(spark)
    return bpe.round_trip(docs.select("doc_id", "text"), path("byte_bpe_50k.json")).drop("text")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_copies", without_near_copies),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: Models and token ids are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None
