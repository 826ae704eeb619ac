"""Vectors, URL rules, archives and shards against plain versions."""

import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest

from tidemark.llm import near_vectors, shards, url_filter, warc
from tidemark.session import work_dir, written


def vectors(spark):
    rand = np.random.Generator(np.random.PCG64(2))
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, float("nan"), 0.0]), (5, [1.0, None, 0.0]), (6, [float("inf"), 1.0, 1.0]),
            (7, [1e-30, 0.0, 0.0]), (8, [3e30, 0.0, 0.0]), (9, [1.0, 0.0, 0.0, 0.0])]
    k = 10
    for _ in range(40):
        centre = rand.standard_normal(16)
        for _ in range(rand.integers(1, 12)):
            rows.append((k, [float(x) for x in centre + rand.standard_normal(16) * rand.choice([0.0, 0.15, 0.25])]))
            k += 1
    rows.append(rows[-1])
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, bucket string"), rows


@pytest.mark.parametrize("block", [near_vectors.BLOCK, 5])
def test_near_groups_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    frame, rows = vectors(spark)
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(np.float32(x)) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    links = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and unit[a] is not None and unit[b] is not None
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95}
    root = brute.components(range(len(rows)), lambda a, b: (a, b) in links)
    want = sorted((r[0], sum((k, b) in links for b in range(len(rows))), rows[root[k]][0]) for k, r in enumerate(rows))
    got = near_vectors.near_groups(frame)
    assert brute.rows(got, "vec_id", "n_links", "component_id") == sorted(want, key=repr)


def test_hashing_finds_the_share_it_is_made_for():
    rand = np.random.Generator(np.random.PCG64(4))
    k, tables = near_vectors.shape(50_000, 0.95)
    a = near_vectors._unit(rand.standard_normal((2000, 64)))
    noise = rand.standard_normal((2000, 64))
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * near_vectors._unit(noise)
    met = (near_vectors.buckets(a, k, tables) == near_vectors.buckets(b, k, tables)).any(1)
    assert met.mean() > 0.98


def test_near_groups_of_nothing(spark):
    assert near_vectors.near_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


URLS = [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/EN/",
        "http://example.net/en", "http://x.example.com/de/", "http://notexample.com/de/", "http://example.org/fr/a", "http://net/", "http://Net?x=/",
        "http://my.casino.io/a", "http://a.io/setup.EXE?x", "x://é.net/中#", "http://a.org/fr/://b.net/", "a\nb://q.net/x\ny", "http://a.net:80/"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    stop = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    path, best = rest[cut:stop], None
    for rule, verdict in url_filter.HOST_RULES:
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (not best or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_url_rules_against_every_rule(spark):
    rows = [(k, u, None, "x") for k, u in enumerate(URLS)] + [(5, URLS[5], "y", "x")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string"), url_filter.rules_table(spark))
    assert got.count() == len(rows)
    for r in got.collect():
        host, path, best = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]), URLS[r["page_id"]]
        if best:
            assert r["verdict"] == best[1]
    told = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert told[URLS.index("http://my.casino.io/a")] == told[URLS.index("http://a.io/setup.EXE?x")] == "block"
    assert told[0] == told[1] == told[2] == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), url_filter.rules_table(spark)).count() == 0


def test_url_index_against_every_pattern(spark):
    """The rule as the SQL has it, on each URL."""
    whole = re.compile(r"(?i)://[^/?#]*\b(casino|pills|adult|(poker|roulette)-?online)\b|\.(exe|msi|apk)([?#]|$)", re.ASCII)
    words = ["poker", "roulette", "Poker", "casino", "pills", "adult", "chess"]
    urls = [f"{scheme}{before}{word}{join}{end}{tail}" for scheme in ("http://", "x") for before in ("", "www.", "my-", "my")
            for word in words for join in ("", "-", "--", ".", "_", "/") for end in ("online", "ONLINE", "onlines", "") for tail in (".com/", ".io/x.apk?q")]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), url_filter.rules_table(spark)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r["verdict"] == ("block" if whole.search(urls[r["page_id"]]) else "allow"), urls[r["page_id"]]
    told = {urls[r["page_id"]]: r["verdict"] for r in got}
    assert told["http://pokeronline.com/"] == told["http://www.roulette-online.com/"] == told["http://www.rouletteonline.io/x.apk?q"] == "block"


def test_url_rules_stay_off_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string").persist()
    plan = url_filter.judge(pages, url_filter.rules_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_loser_tree_merges_like_sorting():
    rand = random.Random(6)
    for many in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rand.choices(range(50), k=rand.randint(0, 20))) for _ in range(many)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def odd_pages(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n中" * 50, "x" * 300_000, ""]
    urls = [None, "http://b.a.net/x", "http://a.net/", "http://a.net/", "bad\r\nurl: 1", "http://é.org/", "http://A.net/#x"]
    rows = [(k, urls[k % 7], html[k % 7], "x") for k in range(40)] + [(3, urls[3], html[3], "x")]
    rows += [(None, "http://a.net/", "<p>a</p>", "x"), (None, "http://a.net/", "alone", "x"), (None, "http://a.net/", "alone", "x")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string, file string").repartition(5)


def history(rows) -> list[tuple]:
    """What the archives must give, in the order of the index, by one plain sort."""
    first = {}
    for k, _, h, _ in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    key = {None: "", "http://b.a.net/x": "net,a,b)/x", "http://a.net/": "net,a)/", "http://A.net/#x": "net,a)/",
           "bad\r\nurl: 1": ")", "http://é.org/": "org,é)/"}
    ordered = sorted((key[u], k is not None, k or 0, hashlib.sha1((h or "").encode()).hexdigest(), h or "") for k, u, h, _ in rows)
    out = []
    for place, (url_key, there, k, _, h) in enumerate(ordered):
        same = place and ordered[place - 1][0] == url_key
        before = ordered[place - 1][2] if same and ordered[place - 1][1] else None
        refers_to = first.get(h) if not (there and k == first.get(h)) else None
        out.append((k if there else None, len(h.encode()), warc.digest(h.encode()), "response" if refers_to is None else "revisit",
                    refers_to, place, before))
    return out


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place", "previous"]


@pytest.mark.parametrize("fan_in, range_rows, block_rows", [(128, 20_000, 512), (2, 4, 2), (3, 7, 1), (128, 1, 3)])
def test_archives_round_trip(spark, fan_in, range_rows, block_rows):
    rows, pages = odd_pages(spark)
    runs = warc.write(pages, work_dir(spark, "warc"), block_rows=block_rows)
    index = written(warc.merged(runs, fan_in, range_rows, block_rows), "index")
    got = sorted((tuple(r) for r in warc.read(spark, index).select(*NAMES).collect()), key=lambda r: r[5])
    assert got == history(rows)


def test_archives_of_nothing(spark):
    _, pages = odd_pages(spark)
    nothing = warc.write(pages.limit(0), work_dir(spark, "warc"))
    assert warc.read(spark, warc.merged(nothing)).count() == 0


def test_merge_holds_a_block_of_each_run(spark, tmp_path, monkeypatch):
    """However long the runs, the merge of a range has read no more blocks than it has given rows of, and one a run."""
    runs, blocks = 5, 40
    parts = []
    for r in range(runs):
        out = warc.RunWriter(str(tmp_path), r)
        told = []
        for k in range(blocks * warc.BLOCK_ROWS):
            told += out.add((f"k{k:07d}", "20240101000000", k * runs + r, "", f"f{r}", k, 1, "response", None))
        parts.append(told + out.close())
    assert all(len(p) == blocks for p in parts)
    read = []
    plain = warc.reader
    monkeypatch.setattr(warc, "reader", lambda path: read.append(path) or plain(path))
    taken = [0] * runs

    def counted(r):
        for item in warc._cursor(parts[r][0]["path"], 0, blocks - 1, None, None):
            taken[r] += 1
            yield item

    last = None
    for n, (key, _) in enumerate(warc.LoserTree([counted(r) for r in range(runs)], warc._by_key), 1):
        assert last is None or last < key
        last = key
        assert sum(taken) <= n + runs
    assert n == runs * blocks * warc.BLOCK_ROWS and len(read) == runs


def test_a_range_opens_runs_where_it_begins(spark):
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.net/') AS url", "'' AS html").repartition(3)
    runs = warc.write(pages, work_dir(spark, "warc"), block_rows=20)
    cuts = warc._cuts(runs, 500)
    assert len(cuts) >= 4 and cuts == sorted(set(cuts))
    assert runs.count() >= 200
    index = warc.merged(runs, range_rows=500)
    got = [tuple(r) for r in index.orderBy("place").select("url_key", "page_id", "previous", "place").collect()]
    want = sorted((f"net,h{k % 50})/", k) for k in range(4000))
    assert [r[:2] for r in got] == want and [r[3] for r in got] == list(range(4000))
    assert [r[2] for r in got] == [want[k - 1][1] if k and want[k - 1][0] == want[k][0] else None for k in range(4000)]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, None, "ab"), (2, None, "ab"), (3, None, "abcd"), (4, None, "abcd")], "page_id bigint, url string, html string")
    captures = warc.merged(warc.write(pages, work_dir(spark, "warc"), at_least=3))
    assert brute.rows(captures, "page_id", "refers_to") == [(1, None), (2, None), (3, None), (4, 3)]


@pytest.mark.parametrize("many", [1, 2, 7, 40])
def test_shards(spark, many):
    documents = brute.odd_documents(spark, many=150)
    got = brute.frame(shards.shard_documents(documents, many))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in documents.collect()))
    assert sorted(zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    assert got["shard"].between(0, many - 1).all()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    # No shard is off the mean by more than the heaviest points.
    sizes = got.groupby("shard")["size"].sum().reindex(range(many), fill_value=0)
    heaviest = got.groupby("text_crc32")["size"].sum().max()
    assert sizes.max() <= sizes.mean() + 2 * heaviest


def test_shards_of_nothing(spark):
    assert shards.shard_documents(brute.empty(spark), 4).count() == 0
