"""Plain versions of what the operators compute, and documents with the odd cases."""

import random
import re

import pandas as pd

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words string"


def odd_documents(spark, seed: int = 1, many: int = 60):
    """Nulls, empty and long texts, copies, near copies and repeated rows; columns that clash."""
    rand = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rand.choices(vocabulary, k=rand.randint(1, 120))) for _ in range(many)]
    texts = [None, "", "  \n\t", "one", "one two", "One  TWO three\tfour", "é ß 中文 ١٢", "a" * 5000, " ".join(vocabulary * 30)]
    for text in base:
        texts += [text, text.upper() if rand.random() < 0.3 else text]
        words = text.split(" ")
        words[rand.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(k, text, None if k % 7 == 0 else "en", f"s{k % 3}", None, 1.5, "x") for k, text in enumerate(texts)]
    rows.append(rows[12])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text: str | None, size: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def components(nodes, linked) -> dict:
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ordered = sorted(root)
    for k, a in enumerate(ordered):
        for b in ordered[:k]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in root}


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def rows(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def frame(df) -> pd.DataFrame:
    return df.toPandas()
