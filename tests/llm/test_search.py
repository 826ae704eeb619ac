"""Matrix BPE, lexical search and spelling variants against the library and plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe_matrix, lexical, spelling
from tidemark.session import written
from test_texts import odd_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- matrix BPE -------------------------------------------------------------


def library(path=RANKS):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe_matrix.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_matrix_bpe_is_the_librarys(name):
    path = public_tokenizers.path(f"{name}.tiktoken")
    own, other = bpe_matrix.Codec(path), library(path)
    rand = random.Random(8)
    long = ["a" * 100_001, " " * 7000, "abc" * 700 + "é" * 400, "=-" * 3000 + "x",
            "".join(rand.choices("abcdeth", k=20_000)), "".join(rand.choices("aab", k=3000))]
    texts = odd_texts(3000) + long
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_matrix_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe_matrix, "REMEMBERED", 20)
    own, other = bpe_matrix.Codec(RANKS), library()
    texts = odd_texts(300)
    for k in range(0, 300, 50):
        assert own.encode(texts[k:k + 50]) == [other.encode_ordinary(t) for t in texts[k:k + 50]]


def test_matrix_bpe_merges_no_piece_in_use_again(monkeypatch):
    monkeypatch.setattr(bpe_matrix, "REMEMBERED", 20)
    own, merge, asked = bpe_matrix.Codec(RANKS), bpe_matrix.Codec.merged, []
    monkeypatch.setattr(bpe_matrix.Codec, "merged", lambda codec, pieces: asked.extend(pieces) or merge(codec, pieces))
    for k in range(0, 120, 12):
        own.encode(["qzxjv" + "".join(f" {n}{n}{n}{n}" for n in range(1000 + k, 1012 + k))])
    assert len(asked) == 121 and asked.count(b"qzxjv") == 1


def test_long_rows_merge_as_short_ones_do(monkeypatch):
    own = bpe_matrix.Codec(RANKS)
    rand = random.Random(9)
    pieces = [bytes(rand.choices(b"abeinst \xc3\xa9", k=rand.randint(2, 250))) for _ in range(300)]
    by_rounds = own.merged(pieces)
    monkeypatch.setattr(bpe_matrix, "LONG", 1)
    assert own.merged(pieces) == by_rounds


def test_pairs_are_found_and_others_are_not():
    import numpy as np
    rand = np.random.Generator(np.random.PCG64(1))
    ways = np.unique(rand.integers(0, 500, (20_000, 2)), axis=0)
    table = bpe_matrix.Pairs(ways[:, 0], ways[:, 1], np.arange(len(ways)))
    assert (table.find(ways[:, 0], ways[:, 1]) == np.arange(len(ways))).all()
    known = set(map(tuple, ways.tolist()))
    asked = rand.integers(-1, 500, (20_000, 2))
    assert all((r != bpe_matrix.NONE) == ((a, b) in known) for r, (a, b) in zip(table.find(*asked.T), asked.tolist()))
    nothing = bpe_matrix.Pairs(*np.zeros((3, 0), np.int64))
    assert (nothing.find(asked[:, 0], asked[:, 1]) == bpe_matrix.NONE).all()


def test_matrix_bpe_frames(spark):
    documents = brute.odd_documents(spark, many=5).withColumn("token_ids", F.lit("clash"))
    both = bpe_matrix.decode(bpe_matrix.encode(documents, RANKS), RANKS)
    assert set(both.columns) == {*documents.columns, "decoded"}
    rows = both.collect()
    assert all((r["text"] or "").encode() == r["decoded"] and r["score"] == 1.5 for r in rows)
    assert len(rows) == documents.count()
    nulls = written(both, "ids").withColumn("token_ids", F.lit(None).cast("array<int>"))
    assert all(r["decoded"] is None for r in bpe_matrix.decode(nulls, RANKS).collect())
    other, want = library(), []
    for r in documents.collect():
        ids = other.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = brute.rows(bpe_matrix.digests(documents, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    assert bpe_matrix.digests(brute.empty(spark), RANKS).count() == 0
    assert bpe_matrix.encode(brute.empty(spark), RANKS).count() == 0


# --- lexical search ---------------------------------------------------------


def best(documents: list, items: list, most: int) -> list:
    """(item_id, rank, doc_id, score), plainly."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    held = [(doc_id, c) for doc_id, c in held if c]
    total, many = sum(sum(c.values()) for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * many // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        found += [(item_id, k + 1, s[2], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:most])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("bucket, block", [(lexical.BUCKET, lexical.BLOCK_BYTES), (7, 900)])
def test_search_against_all_scores(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEED", 10 * bucket)
    documents = brute.odd_documents(spark, many=60)
    unnamed = documents.where("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("bigint"))
    documents = documents.union(unnamed).repartition(4)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rand = random.Random(4)
    texts = [t for _, t in rows if t and len(t) < 2000]
    items = [(k, " ".join(rand.choice(texts).split()[:rand.randint(1, 30)])) for k in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, "nowhere to be met"), (None, "one two w3"), (104, items[0][1]), (104, "W1 w1 É")]
    frame = spark.createDataFrame([(*i, 0, "x") for i in items], "item_id bigint, text string, rank int, score string")
    for most in (3, 50):
        got = lexical.search(documents, frame, most=most, block_bytes=block)
        assert brute.rows(got, "item_id", "rank", "doc_id", "score") == best(rows, items, most)


def test_bucket_with_short_vectors_before_longer_ones(spark):
    """A task reads several files, so a bucket may begin with the short vectors that end one of them."""
    items = lexical._items(["aa"])
    items.weights = np.array([100])
    rows = [(1, [0], [10], 100.0), (2, [0], [500], 5000.0)]
    found = spark.createDataFrame(rows, "doc_id bigint, terms array<int>, impacts array<bigint>, length double").coalesce(1)
    got = lexical._searched(found, spark.sparkContext.broadcast(items), np.array([40_000]), 50)
    assert [tuple(r) for r in got.collect()] == [(0, 2, 50_000)]


def test_best_keeps_the_best_of_many():
    rand = random.Random(3)
    for many in (201, 500, 5000):
        for _ in range(20):
            scores = np.array([rand.randint(1, many) for _ in range(many)])
            kept = lexical.Best(50, 1)
            kept.offer(scores, pa.array(range(many)))
            wanted = sorted((-s, k) for k, s in enumerate(scores.tolist()))[:50]
            assert sorted((-e[0], -e[2]) for e in kept.heap) == wanted


def test_length_of_a_small_vector_behind_large_ones(spark):
    """A vector's length is that of its own coordinates, whatever is before it in the batch."""
    items = lexical._items(["aa bb"])
    items.weights = np.array([1, 14_000])[np.argsort(np.argsort(items.terms))]
    rows = [(k, 1, [1], [1]) for k in range(5000)] + [(9000, 2_000_000, [0], [1])]
    counted = spark.createDataFrame(rows, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>").coalesce(1)
    found = lexical.vectors(counted, spark.sparkContext.broadcast(items), 5001, 2_005_000).where("doc_id = 9000").first()
    assert found["length"] == found["impacts"][0] > 0


def test_thresholds_prune(spark):
    """Most vectors are ruled out by their length or a few coordinates, not scored."""
    items = lexical._items(["aa bb cc dd ee ff gg hh"])
    common = [(k, "aa " * (1 + k % 3) + f"filler{k} " * 30) for k in range(2000)]
    documents = spark.createDataFrame(common + [(9000 + k, "aa bb cc dd ee ff gg hh") for k in range(60)], "doc_id bigint, text string")
    terms = spark.sparkContext.broadcast(items.terms)
    counted = written(lexical.term_counts(documents, terms), "terms")
    totals = counted.agg(F.count("*"), F.sum("n")).first()
    lexical._weighted(items, counted, totals[0])
    found = lexical.vectors(counted, spark.sparkContext.broadcast(items), *totals).toArrow().combine_chunks().to_batches()[0]
    bucket = lexical.Bucket(found)
    held = items.held[0]
    focus = held[items.weights[held].argsort()[::-1][:lexical.FOCUS]]
    rest = math.sqrt(items.weights[held].sum() - items.weights[focus].sum())
    values = items.weights.copy()
    import numpy as np
    scores = bucket.scores(np.arange(len(bucket.lengths)), values)
    threshold = int(np.sort(scores)[-50])
    rows = bucket.candidates(focus, items.weights, rest, threshold)
    assert set(np.flatnonzero(scores >= threshold)) <= set(rows.tolist()) and len(rows) < 100


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    documents = brute.odd_documents(spark, many=3)
    assert lexical.search(brute.empty(spark), items).count() == 0
    assert lexical.search(documents, items.limit(0)).count() == 0
    assert lexical.search(documents.withColumn("text", F.lit(None).cast("string")), items).count() == 0


# --- spelling variants ------------------------------------------------------


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_variants(documents: list) -> list:
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in beside.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        if top is not None and n[top] >= 2 * n[w]:
            form[w] = top

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(beside[w]), n.get(form.get(w))) for w in n), key=repr)


def spelled(spark, seed: int):
    rand = random.Random(seed)
    stems = ["".join(rand.choices("abé", k=rand.randint(5, 7))) for _ in range(60)] + ["aaaaa" + c for c in "abcdefghij"] + ["x" * 700, "x" * 701]
    rows = []
    for k in range(120):
        some = [rand.choices(stems, weights=[1 / (j + 1) for j in range(len(stems))])[0] for _ in range(40)]
        some = [w.upper() if rand.random() < 0.2 else w for w in some]
        rows.append((k if k % 11 else None, rand.choice([" ", "-", "3", "× "]).join(some), "x", k))
    rows += [(500, None, "x", 0), (501, "", "x", 0), (502, "ñ" * 40 + " " + "ñ" * 39, "x", 0)] + rows[:10]
    return spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int"), [r[:2] for r in rows]


@pytest.mark.parametrize("seed, tile, block", [(1, spelling.TILE, spelling.BLOCK), (2, 4, 3)])
def test_variants_against_all_pairs(spark, monkeypatch, seed, tile, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    documents, rows = spelled(spark, seed)
    got = brute.rows(spelling.variants(documents, tile=tile), "word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(rows)
    assert got == want and any(w[1] for w in want) and any(w[2] != (w[1] or w[0]) for w in want)


def test_tiles_of_a_large_group_are_bounded(spark):
    letters = "abcdefghijklmnopqrst"
    listed = spark.createDataFrame([("aaaa" + a + b + c, 3) for a in letters for b in letters for c in letters[:5]], "word string, n bigint")
    sizes = spelling.tiles(listed, 100).groupBy(*spelling.GROUP).count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 100 * 1.5
    got = spelling.pairs(listed, 100)
    assert got.count() == got.distinct().count() == 2000 * (19 + 19 + 4)


def test_spelling_of_nothing(spark):
    assert spelling.variants(brute.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "ab cd")], "doc_id bigint, text string")
    assert spelling.variants(one).count() == 0
