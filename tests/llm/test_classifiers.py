"""Both classifiers: held-out accuracy on planted kinds of text, odd cases, and the models' arithmetic."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.labelled import fold, sample, training


def corpus(spark, many: int = 500):
    """Prose of invented words; some shouts, some repeats itself, some insults."""
    rand = random.Random(11)
    syllables = ["an", "ther", "on", "ti", "re", "ha", "sh", "wh", "ou", "ble", "en", "st", "ed", "ing"]
    vocabulary = ["".join(rand.choices(syllables, k=rand.randint(1, 4))) for _ in range(1500)]
    insults = ["vexbrut", "grolmok", "zanquit"]
    rows, labels = [], []
    for k in range(many):
        words = rand.choices(vocabulary, k=rand.randint(20, 150))
        good, toxic = 1, 0
        if k % 6 == 0:
            words, good = [w.upper() + "!!" for w in words], 0
        elif k % 6 == 1:
            words, good = [w for w in words[:5] for _ in range(20)], 0
        if k % 4 == 3:
            toxic = 1
            for _ in range(rand.randint(2, 5)):
                words.insert(rand.randrange(len(words)), rand.choice(insults) + rand.choice(["", "ed", "ing"]))
        rows.append((k, " ".join(words), None, "s", None, 0.5, "x"))
        labels.append((k, good, toxic))
    rows += [(many + k, text, None, None, None, None, None) for k, text in enumerate([None, "", " \n", "x", "y " * 30_000])]
    labels += [(many, None, None), (many + 1, 1, 0), (None, 1, 1), (2, 1, 0)]
    return (spark.createDataFrame(rows, brute.SCHEMA).repartition(3),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), many)


def held_out_accuracy(scored, labels, label, folds, held_out, many) -> float:
    rows = scored.join(labels.groupBy("doc_id").agg(F.max(label).alias("truth")), "doc_id").where(
        (fold(F.col("doc_id"), folds) == held_out) & (F.col("doc_id") < many)).select("score", "truth").collect()
    assert len(rows) > 50
    return sum((r["score"] >= 0.5) == (r["truth"] == 1) for r in rows) / len(rows)


def test_quality(spark):
    documents, labels, many = corpus(spark)
    model = quality.train(documents, training(labels, "quality", 4, 2))
    scored = quality.scored(documents, *model)
    assert scored.columns == [*[c for c in documents.columns if c != "score"], "score"]
    assert scored.count() == documents.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert held_out_accuracy(scored, labels, "quality", 4, 2, many) > 0.93
    again = quality.scored(documents, *quality.train(documents, training(labels, "quality", 4, 2)))
    assert brute.rows(scored, "doc_id", F.round("score", 6)) == brute.rows(again, "doc_id", F.round("score", 6))


def test_toxicity(spark):
    documents, labels, many = corpus(spark)
    model = toxicity.train(documents, training(labels, "toxic", 5, 0))
    scored = toxicity.scored(documents, model)
    assert scored.count() == documents.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert held_out_accuracy(scored, labels, "toxic", 5, 0, many) > 0.93


@pytest.mark.parametrize("rows", [[], [(0, 1, 1), (1, 1, 1)], [(999, 1, 0)]])
def test_too_few_labels(spark, rows):
    documents = brute.odd_documents(spark, many=3)
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    for scored in (quality.scored(documents, *quality.train(documents, training(labels, "quality", 4, 2))),
                   toxicity.scored(documents, toxicity.train(documents, training(labels, "toxic", 5, 0)))):
        assert scored.count() == documents.count()
        assert scored.select("score").distinct().count() == 1


def test_no_documents(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.scored(brute.empty(spark), *quality.train(brute.empty(spark), training(labels, "quality", 4, 2))).isEmpty()
    assert toxicity.scored(brute.empty(spark), toxicity.train(brute.empty(spark), training(labels, "toxic", 5, 0))).isEmpty()


def test_held_out_rows_and_samples(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id bigint, quality int, toxic int")
    own = training(labels, "quality", 4, 2)
    assert own.where(fold(F.col("doc_id"), 4) == 2).isEmpty()
    assert sample(own, 10).count() == 10
    assert brute.rows(sample(own, 10), "doc_id") == brute.rows(sample(own.repartition(5), 10), "doc_id")


def plain_evidence(counts: dict) -> tuple[dict, dict]:
    """Evidence of grams and of contexts, from (gram -> [n ordinary, n toxic]); one by one."""
    d, lean = toxicity.DISCOUNT, toxicity.LEAN
    levels = {toxicity.ORDER: {g: sum(n) for g, n in counts.items()}}
    for order in range(toxicity.ORDER - 1, 1, -1):
        levels[order] = {}
        for gram, n in levels[order + 1].items():
            low = gram & ((1 << 8 * order) - 1)
            levels[order][low] = levels[order].get(low, 0) + (n if gram < 1 << 8 * order else 1)
    totals = {}
    for order in range(2, toxicity.ORDER):
        for gram, n in levels[order].items():
            total, types = totals.get((order, gram >> 8), (0, 0))
            totals[order, gram >> 8] = (total + n, types + 1)

    def shared(order, gram):
        if order == 1:
            return 1 / 256
        gram &= (1 << 8 * order) - 1
        total, types = totals[order, gram >> 8]
        return (max(levels[order][gram] - d, 0) + d * types * shared(order - 1, gram)) / total

    contexts = {}
    for gram, n in counts.items():
        own = contexts.setdefault(gram >> 8, [[0, 0], [0, 0], [0, 0]])
        for c, k in enumerate((*n, sum(n))):
            own[c][0] += k
            own[c][1] += k > 0

    def evidence(context, met, below):
        def estimate(c):
            total, types = contexts[context][c]
            return (max(met[c] - d, 0) + d * types * below) / total if total else below
        leaning = [(contexts[context][c][0] * estimate(c) + lean * estimate(2)) / (contexts[context][c][0] + lean) for c in (0, 1)]
        return np.log(leaning[1] / leaning[0])

    return ({g: evidence(g >> 8, (*n, sum(n)), shared(toxicity.ORDER - 1, g)) for g, n in counts.items()},
            {c: evidence(c, (0, 0, 0), 1.0) for c in contexts})


def test_models_against_plain_counts(spark):
    documents, labels, _ = corpus(spark, 60)
    halved = training(labels, "toxic", 5, 0).withColumn("half", (F.col("doc_id") % 2).cast("int"))
    counts = toxicity._counted(documents.select("doc_id", "text").join(halved, "doc_id"))
    plain = {}
    for r in documents.join(halved, "doc_id").select("label", "half", "text").collect():
        for word in brute.words(r["text"]):
            data = b" " + word.encode()
            for k in range(1, len(data)):
                gram = int.from_bytes(data[max(0, k + 1 - toxicity.ORDER):k + 1], "big")
                plain[gram, r["label"], r["half"]] = plain.get((gram, r["label"], r["half"]), 0) + 1
    assert {(r["gram"], r["label"], r["half"]): r["n"] for r in counts.collect()} == plain
    grams, unmet = [df.collect() for df in toxicity.models(counts)]
    for model, halves in ((toxicity.ALL, (0, 1)), (0, (1,)), (1, (0,))):
        own = {}
        for (gram, label, half), n in plain.items():
            if half in halves:
                own.setdefault(gram, [0, 0])[label] += n
        for want, rows in zip(plain_evidence(own), (grams, unmet)):
            got = {r["gram"]: r["evidence"] for r in rows if r["model"] == model}
            assert got.keys() == want.keys()
            assert all(abs(got[g] - want[g]) < 1e-9 for g in want)


@pytest.mark.parametrize("block", [1 << 21, 30_000])
def test_every_gram_keeps_its_evidence(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block, raising=False)
    rows = spark.range(100_000).select(F.lit(toxicity.ALL).alias("model"), (F.col("id") * 7919).alias("gram"),
                                       F.lit(1).cast("long").alias("n"), (F.col("id") / 7).alias("evidence"))
    table = toxicity._table(rows, toxicity.ALL)
    known, evidence = table.find(np.arange(100_000) * 7919)
    assert known.all()
    assert np.allclose(evidence, np.arange(100_000) / 7)
    assert not table.find(np.array([1, 7920]))[0].any()


def test_blocks_do_not_change_scores(spark, monkeypatch):
    documents, labels, _ = corpus(spark, 100)
    told = []
    for block in (1 << 21, 500):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        model = toxicity.train(documents, training(labels, "toxic", 5, 0))
        assert (len(model.met.blocks) > 1) == (block == 500)
        told.append(brute.rows(toxicity.scored(documents, model), "doc_id", F.round("score", 9)))
    assert told[0] == told[1]


def test_word_vectors_count_neighbours(spark):
    documents = spark.createDataFrame([(1, "a b, c"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    want = np.zeros((quality.CELLS, quality.DIMS))
    dims, signs = quality._index()
    for text in (["a", "b", ",", "c"], ["a", "b"]):
        cells = [int(quality._cells(quality.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), quality.SIGNS))[0]) for t in text]
        for i in range(len(cells)):
            for j in range(len(cells)):
                if 0 < abs(i - j) <= quality.NEAR:
                    np.add.at(want[cells[i]], dims[cells[j]], signs[cells[j]])
    norms = np.maximum(np.sqrt((want ** 2).sum(1, keepdims=True)), 1e-9)
    assert np.allclose(quality.word_vectors(documents), want / norms, atol=1e-6)


def test_temperature_keeps_the_order():
    rand = np.random.Generator(np.random.PCG64(1))
    x = rand.standard_normal((400, 5))
    net = quality.fit(x, (x[:, 0] + 0.3 * rand.standard_normal(400) > 0).astype(float))
    assert (np.argsort(net.logits(x)) == np.argsort(net.logits(x) / net.temperature)).all()
    assert ((net.score(x) > 0.5) == (x[:, 0] > 0)).mean() > 0.85
