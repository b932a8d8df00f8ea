"""Lexical search, URL filter and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lexical_search, registry, resampling, url_filter
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, items, k):
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, length, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def test_search_equals_scoring_all(spark, docs, rows, nothing, monkeypatch):
    rng = random.Random(8)
    texts = [t for _, t in rows if t]
    items = [(i, " ".join(rng.choice(texts).split()[:12])) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere x9y"), (53, "one ONE one Été 日本語"), (53, "one ONE one Été 日本語"), (None, "one two")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit("x")).withColumn("doc_id", F.lit("y"))
    for k in (3, 20):
        assert Counter(map(tuple, lexical_search.search(docs, asked, k).collect())) == ranked(rows, items, k)
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 300)  # several blocks of queries
    assert Counter(map(tuple, lexical_search.search(docs, asked, 5).collect())) == ranked(rows, items, 5)
    assert lexical_search.search(nothing, asked).count() == lexical_search.search(docs, asked.where("false")).count() == 0


def test_small_shards_and_long_terms(spark, monkeypatch):
    """Shards of a few documents, terms over eight bytes that begin alike, and a hot term in every document."""
    rng = random.Random(9)
    names = [f"commonbeginning{i}" for i in range(40)] + [f"w{i}" for i in range(40)]
    rows = [(i, "hot " * rng.randrange(1, 4) + " ".join(rng.choices(names, k=rng.randrange(0, 30)))) for i in range(400)]
    items = [(i, "hot " + " ".join(rng.choices(names, k=6))) for i in range(10)]
    got = lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert Counter(map(tuple, got.collect())) == ranked(rows, items, 7)


def test_shards_end_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 3)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 4)
    vocabulary, rows = lexical_search.Vocabulary([b"a", b"b"]), []

    class Frame:  # runs the builder on one batch of 10 documents
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                broadcast = staticmethod(lambda x: type("B", (), {"value": x}))

        def mapInArrow(self, f, schema):  # noqa: N802
            batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(["a b", "x", "", "a", "b b b", "a", "a b", None, "c b", "a"])], ["doc_id", "text"])
            rows.extend(r for b in f(iter([batch])) for r in b.to_pylist())

    lexical_search.index(Frame(), vocabulary)
    assert len(rows) > 1 and all(len(r["ids"]) <= 3 for r in rows)
    assert sum(r["n_docs"] for r in rows) == 8 and sum(r["n_terms"] for r in rows) == 13
    assert sorted(i for r in rows for i in r["ids"]) == [0, 3, 4, 5, 6, 8, 9]
    assert sum(sum(r["tf"]) for r in rows) == 11


def test_unessential_lists_are_only_probed():
    """Once the k-th best score is known, far fewer postings are read than there are, and nothing is lost."""
    rng = np.random.default_rng(4)
    n, df = 5000, [5000, 4000, 60]
    at = [np.sort(rng.choice(n, x, replace=False)) for x in df]
    row = {"n": rng.integers(5, 60, n), "terms": np.arange(3), "df": np.array(df), "at": np.concatenate(at), "tf": np.ones(sum(df), np.int64)}
    shard = lexical_search.Shard(row, np.array([10, 200, 6000]), n, int(row["n"].sum()))
    query = [(0, 1), (1, 1), (2, 1)]
    docs, score = shard.search(query, 1)
    assert shard.looked == sum(df)
    least, shard.looked = int(np.sort(score)[-20]), 0
    top, high = shard.search(query, least)
    assert shard.looked < sum(df) // 20
    assert dict(zip(top.tolist(), high.tolist())) == {d: s for d, s in zip(docs.tolist(), score.tolist()) if s >= least}


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, None))


def test_rules_equal_a_plain_match(spark):
    rng = random.Random(3)
    rules = [*registry.URL_RULES, ("block", "com", "/en/deep/"), ("allow", "a.example.com", "/"), ("allow", "org", "/x"), ("block", "org", "/x")]
    hosts = ["example.com", "www.example.com", "A.Example.COM", "x.a.example.com", "b.net", "net", "xcom", "com", "www.example.com:80", "", "org", "q.org."]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/deep/x', '/es/1', '/fr', '/fr/', '/x/y'])}{rng.choice(['', '?a=1&b=2', '#t', '?u=http://z.com/es/', '/%20é'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/es/", "http://h\nh.net/es/\nx?y\nz#f\ng", "http://" + "a." * 3000 + "net/es/"]
    pages = spark.createDataFrame([(i % 350, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)
    for c in ("host", "site", "_row", "verdict", "n", "y", "a.b"):
        pages = pages.withColumn(c, F.lit("x"))
    got = url_filter.url_filter(pages, url_filter.rule_table(spark, rules)).collect()
    fixed = [(i % 350, *judged(u, rules)) for i, u in enumerate(urls)]
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == Counter(x[:4] for x in fixed)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["rule"]) == Counter(x for x in fixed if x[3])
    assert all((r["score"] is None) == (r["rule"] is not None) and r["verdict"] in ("allow", "block") for r in got)
    assert url_filter.url_filter(pages.where("false"), url_filter.rule_table(spark, rules)).count() == 0
    none = url_filter.url_filter(pages, url_filter.rule_table(spark, [])).collect()
    assert len(none) == len(urls) and {(r["rule"], r["verdict"], r["score"]) for r in none} == {(None, "allow", 0.0)}


def test_trees_learn_from_labelled_urls(spark):
    """Held-out accuracy where digits, parameters and the site tell what is blocked."""
    rng = random.Random(12)

    def url(bad):
        site = rng.choice(["shop-offers.biz", "casino-win.top"] if bad and rng.random() < 0.5 else ["paper.org", "notes.org", "club.org"])
        name = "".join(rng.choices("0123456789abcdef" if bad else "aeilnorst", k=rng.randrange(6, 16)))
        tail = "?" + "&".join(f"{rng.choice('abcd')}={rng.randrange(10**6)}" for _ in range(rng.randrange(2, 6))) if bad and rng.random() < 0.9 else ""
        return f"http://www.{site}/{name}/{rng.randrange(100)}{tail}"

    labels = spark.createDataFrame([(url(i % 2 == 0), i % 2 == 0) for i in range(3000)], "url string, blocked boolean")
    held = [(i, url(i % 2 == 0)) for i in range(1000)]
    got = url_filter.url_filter(spark.createDataFrame(held, "page_id long, url string"), url_filter.rule_table(spark, []), labels.withColumn("blocked", F.col("blocked").cast("int"))).collect()
    assert len(got) == 1000 and sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got) >= 970


def test_url_query_covers_the_table(spark, sf_dir):
    got = {r["page_id"]: r for r in registry.queries()["op12_url_filter"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages) and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    for p in pages:
        host, path, rule, verdict = judged(p["url"], registry.URL_RULES)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_checksums():
    rng = random.Random(2)
    runs = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    data, end = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([len(r) for r in runs])
    start = end - [len(r) for r in runs]
    before = np.array([rng.randrange(2**32) for _ in runs], np.uint32)
    assert resampling.crc(before, data, start, end).tolist() == [zlib.crc32(r, int(b)) for r, b in zip(runs, before)]


def drawn(rows, target, n, buckets, percent, least):
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    each = [(i, len(words(t)), features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (big + buckets)) / ((s[b] + 1) * (small + buckets)))) for b in s}
    out = []
    for i, w, f in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w])
    long = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for r, x in enumerate(long[: percent * len(long) // 100], 1):
        x[4] = r
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("n,buckets,percent,least", [(1, 10_000, 10, 20), (2, 500, 30, 5), (3, 50, 100, 1)])
def test_resampling_equals_a_plain_version(spark, docs, rows, nothing, n, buckets, percent, least):
    rng = random.Random(6)
    target = [prose(rng, 40) for _ in range(20)] + ["été 日本語 " + "y" * 200, None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, frame, n, buckets, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == drawn(rows, target, n, buckets, percent, least)
    assert resampling.resample(nothing, frame, n, buckets).count() == 0
    assert resampling.resample(docs, frame.where("false"), n, buckets, percent, least).where("rank IS NOT NULL").count() == percent * sum(len(words(t)) >= least for _, t in rows) // 100


def test_ranks_of_a_crowd(spark):
    """Half of the rows have one id and score; the ranks are still 1, 2, 3 ..."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 11).alias("score"), F.col("id").alias("_row"))
    from kindred.llm.shared import shared_dir

    got = resampling.ranked(rows, 60, shared_dir(spark, "crowd")).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 2401))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in rows.collect())[:2400]
