"""The pipeline's stages on the smallest table, each against a plain version on what it was given."""

import brute
import public_tokenizers
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.session import written
from tokenizers import Tokenizer


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, given = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = written(stage(spark, docs, DATA), name)
        if name != "bpe":
            assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= given[name].keys()
        gone = given[name].keys() - kept
        known = [labels[d] for d in given[name] if d in labels]
        if name == "toxicity":
            clean = [r["doc_id"] for r in known if r["toxic"] == 0]
            assert sum(d in gone for d in clean) <= 0.05 * len(clean)
        elif name == "quality":
            assert sum((r["doc_id"] in gone) == (r["quality"] == 0) for r in known) > 0.9 * len(known)
        elif name == "near_copies":
            sets = {d: brute.shingle_set(t, 5) for d, t in given[name].items()}
            root = brute.components(sets, lambda a, b: len(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
            assert kept == {d for d in sets if root[d] == d}
        elif name == "decontamination":
            wanted = {w for i in items for w in windows(i, True)}
            assert kept == {d for d, t in given[name].items() if not windows(t) & wanted}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for r in docs.collect():
                assert r["token_ids"] == library.encode(given[name][r["doc_id"]] or "", add_special_tokens=False).ids
                assert r["decoded"] == (given[name][r["doc_id"]] or "")
            assert kept == given[name].keys()


def windows(text, item=False, size=10) -> set:
    """Runs of ten words; a shorter item is one run, and documents' runs of all its lengths count."""
    w = brute.words(text)
    sizes = [min(size, len(w))] if item else range(1, size + 1)
    return {tuple(w[k:k + n]) for n in sizes if n for k in range(len(w) - n + 1)}


def test_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_columns_of_clashing_names_keep_their_values(spark):
    """Extra columns of the names that operators use come through the filters as they were."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(150)
    own = {"score": F.lit(7.25), "n_words": F.lit("w"), "n_hit": F.lit(-1), "item_ids": F.col("doc_id"), "spans": F.lit("s"),
           "row_number": F.col("doc_id") * 2, "label": F.lit("l"), "half": F.lit(0.5), "component_id": F.lit("c")}
    unnamed = docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint"))
    docs = written(docs.union(unnamed).union(docs.limit(3)).withColumns(own), "docs")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns and kept.schema == docs.schema
        rows = kept.collect()
        assert rows and all((r["score"], r["n_words"], r["n_hit"], r["spans"], r["label"], r["half"], r["component_id"])
                            == (7.25, "w", -1, "s", "l", 0.5, "c") for r in rows), name
        assert all(r["item_ids"] == r["doc_id"] and (r["doc_id"] is None or r["row_number"] == 2 * r["doc_id"]) for r in rows)


def test_items_without_id_hit(spark):
    words = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"x y {words} z"), (2, "x y z"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, words), (5, " ".join(f"w{k}" for k in range(12)))], "item_id bigint, text string")
    from tidemark.llm import decontaminate
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.marked(docs, items).collect()}
    assert got == {1: (17, 14, ["5"]), 2: (3, 0, []), 3: (0, 0, [])}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [2, 3]
