"""The queries opN_<name>: each operator over its whole table."""

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    bpe, bpe_matrix, decontaminate, jaccard, lexical, near_vectors, quality, shards, spelling, token_files, toxicity,
    url_filter, warc,
)
from tidemark.llm.labelled import fold, training
from tidemark.session import work_dir, written

#: From which score on a document is of good quality, or toxic.
QUALITY, TOXIC = 0.7, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = training(_table(spark, sf_dir, "labels"), "quality", folds=4, held_out=2)
    scored = quality.scored(documents, *quality.train(documents, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = training(_table(spark, sf_dir, "labels"), "toxic", folds=5, held_out=0)
    scored = toxicity.scored(documents, toxicity.train(documents, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_vectors.near_groups(_table(spark, sf_dir, "embeddings"), 0.95)
    return groups.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = warc.write(_table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    index = written(warc.merged(runs), "index")
    return warc.read(spark, index)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shards.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), jaccard.Rule(size=4, percent=85))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), folder, path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder, digest=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.marked(documents, _table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_bpe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.digests(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(_table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_near_vectors": op4_near_vectors,
    "op5_url_filters": op5_url_filters,
    "op6_warc": op6_warc,
    "op7_shards": op7_shards,
    "op8_jaccard": op8_jaccard,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_bpe_matrix": op11_bpe_matrix,
    "op12_lexical": op12_lexical,
    "op13_spelling": op13_spelling,
}
