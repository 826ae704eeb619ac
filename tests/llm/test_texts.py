"""BPE, token files, decontamination and Jaccard classes against plain versions."""

import random
import zlib
from itertools import chain

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontaminate, jaccard, token_files
from tidemark.session import settings, work_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = list("abz'stA  \n\t\r\x0b\x1c\x1f\x85\xa0\u2000\u2028\u3000\u0301éßΣσς12½²٣!?.,<|>中👍\u200d\u1100\u1161İǅﬁ\x00\x7f\ufeff") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", "  ", "\n\n"]


def odd_texts(many: int) -> list[str]:
    rand = random.Random(3)
    return ["".join(rand.choices(ODD, k=rand.randint(0, 40))) for _ in range(many)] + ["a" * 3000, "ab " * 2000, "\n" * 50]


def test_bpe_is_the_librarys():
    codec, library = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    for text in odd_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_broken_sequences_like_the_library():
    codec, library = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    rand = random.Random(5)
    for _ in range(500):
        ids = [rand.randrange(300) for _ in range(rand.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_merges_again_only_what_went_out_of_use(monkeypatch):
    own, other = bpe.Codec(BYTE), bpe.Codec(BYTE)
    merged, plain = [], own.merged
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    own.merged = lambda data: merged.append(data) or plain(data)
    for k in range(12):
        text = f"always qx{chr(97 + k)} zy{chr(97 + k)}"
        assert own.encode(text) == list(chain.from_iterable(map(other.merged, map(str.encode, other.pattern.findall(text)))))
        assert len(own.remembered) + len(own.earlier) <= 8
    assert merged.count(b"always") == 1 and len(merged) == 25
    own.forget()
    own.encode("always")
    assert merged.count(b"always") == 2


def test_bpe_frames(spark):
    documents = brute.odd_documents(spark, many=5).withColumn("token_ids", F.lit("clash"))
    both = bpe.decode(bpe.encode(documents, BYTE), BYTE)
    assert set(both.columns) == {*documents.columns, "decoded"}
    assert all((r["text"] or "") == r["decoded"] for r in both.collect())
    assert both.count() == documents.count()
    assert bpe.digests(brute.empty(spark), BYTE).count() == 0
    assert bpe.encode(brute.empty(spark), BYTE).count() == 0


def test_word_encoder_is_the_librarys():
    own, library = token_files.Encoder(WORD), Tokenizer.from_file(WORD)
    texts = odd_texts(6000) + ["Été, où? Straße. 12. a,b .. X.\nİ, <|STARTOFTEXT|> it's IT'S,", "don'T. 'll, ÿ. µ, ª. ²,"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_encoder_with_another_vocabulary():
    own, library = token_files.Encoder(BYTE), Tokenizer.from_file(BYTE)
    assert not own.by_words and token_files.Encoder(WORD).by_words
    texts = odd_texts(500) + ["Hello, World. It's  two spaces\nand a line."]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_tell_no_id_from_the_smallest(spark):
    documents = spark.createDataFrame([(None, "b"), (-(1 << 63), "a"), (None, "c"), (7, "d")], "doc_id bigint, text string")
    folder = work_dir(spark, "tokens")
    token_files.write(documents, folder, WORD, 1)
    found = token_files.read(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, -(1 << 63), 7]


def test_token_files_round_trip(spark):
    documents = brute.odd_documents(spark, many=15)
    documents = documents.union(documents.where("doc_id = 12").limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    folder = work_dir(spark, "tokens")
    token_files.write(documents.repartition(4), folder, WORD, 1)
    library = Tokenizer.from_file(WORD)
    want, at = [], 0
    for r in documents.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = {(r["doc_id"], r["start"]): r for r in token_files.read(spark, folder).collect()}
    digests = {(r["doc_id"], r["start"]): r for r in token_files.read(spark, folder, digest=True).collect()}
    assert len(got) == len(want)
    for doc_id, start, n, crc, ids in want:
        assert got[doc_id, start]["token_ids"] == ids and got[doc_id, start]["n_tokens"] == n
        assert digests[doc_id, start]["ids_crc32"] == crc
    nothing = work_dir(spark, "tokens")
    token_files.write(brute.empty(spark), nothing, WORD, 1)
    assert token_files.read(spark, nothing).count() == 0


def hits(text, items, size=10):
    w, covered, names = brute.words(text), set(), set()
    for item, other in items:
        own = brute.words(other)
        n = min(size, len(own))
        windows = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in windows:
                covered.update(range(k, k + n))
                names.add(str(item))
    return len(w), len(covered), sorted(names)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_decontamination_against_windows(spark, block):
    documents = brute.odd_documents(spark)
    texts = [r["text"] for r in documents.collect() if r["text"]]
    rand = random.Random(9)
    items = [(1, None), (2, ""), (3, "ONE two!"), (4, "中文"), (5, "not in any of them at all, nowhere to be found here")]
    for k in range(30):
        w = rand.choice(texts).split(" ")
        at = rand.randrange(len(w))
        items.append((10 + k, "start " + " ".join(w[at:at + rand.randint(1, 40)]) + " changed"))
        items.append((100 + k, " ".join(w[at:at + rand.randint(1, 40)])))
    items.append(items[-1])
    benchmark = spark.createDataFrame([*items, (None, "one two")], "item_id bigint, text string")
    got = decontaminate.marked(documents, benchmark, most=block)
    assert got.count() == documents.count()
    for r in got.collect():
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == hits(r["text"], items), r["doc_id"]
    clean = decontaminate.clean(documents, benchmark)
    assert clean.columns == documents.columns
    assert clean.count() == got.where("n_hit = 0").count()


def test_decontamination_of_nothing(spark):
    documents = brute.odd_documents(spark, many=3)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(documents, none).count() == documents.count()
    some = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert decontaminate.marked(brute.empty(spark), some).count() == 0


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85), jaccard.Rule(5, 80), jaccard.Rule(1, 50)])
def test_classes_against_all_pairs(spark, rule):
    documents = brute.odd_documents(spark)
    sets = {r["doc_id"]: brute.shingle_set(r["text"], rule.size) for r in documents.collect()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return x and y and 100 * len(x & y) >= rule.percent * len(x | y)

    root = brute.components(sets, linked)
    got = jaccard.classes(documents, rule).collect()
    assert len(got) == documents.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]])
    left = jaccard.one_of_each(documents, rule)
    assert left.columns == documents.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, r in root.items() if d == r}


def test_classes_with_listed_shingles_and_a_large_group(spark, monkeypatch):
    """Frequent shingles are ordered last whether all, some or none are listed; a chain of near copies holds together."""
    rand = random.Random(4)
    words = [f"v{k}" for k in range(300)]
    shared = " ".join(words[:60])
    texts = [shared + " " + " ".join(rand.choices(words, k=80)) for _ in range(40)]
    chain = words[:100]
    for k in range(60):
        chain = [*chain[:k], f"n{k}", *chain[k + 1:]]
        texts.append(" ".join(chain))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = {k: brute.shingle_set(t, 5) for k, t in enumerate(texts)}
    want = brute.components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for listed in (jaccard.LISTED, 20, 0):
        monkeypatch.setattr(jaccard, "LISTED", listed)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(documents).collect()}
        assert got == want


def test_one_row_of_each_with_repeated_and_null_ids(spark):
    x, y, z = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(5, x), (5, x), (None, x), (None, x), (7, x), (7, y), (None, z), (None, z), (None, None), (None, ""), (9, None)]
    left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert brute.rows(left, "doc_id", "text") == sorted([(5, x), (7, y), (None, z), (None, None), (None, ""), (9, None)], key=repr)
    assert jaccard.one_of_each(brute.empty(spark)).count() == 0


def test_only_texts_that_may_go_are_dealt_out(spark):
    """Of many documents few are copies: the join that leaves them out reads few others."""
    rows = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}") for i in range(300)]
    rows += [(1000 + i, text) for i, text in rows[:10]]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(r.doc_id for r in left.collect()) == list(range(300))
        plan = left._jdf.queryExecution().optimizedPlan().toString()
    before_join = plan[plan.index("Join LeftAnti"):]
    assert "marked(" in before_join and "Union" in plan[:plan.index("Join LeftAnti")]


def test_classes_of_nulls_and_nothing(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, None), (1, "")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert brute.rows(got, "doc_id", "n_shingles", "component_id") == sorted(
        [(None, 2, 3), (None, 2, 3), (3, 2, 3), (2, 0, 2), (1, 0, 1)], key=repr)
    assert jaccard.classes(brute.empty(spark)).count() == 0
