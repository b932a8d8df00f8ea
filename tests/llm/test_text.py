"""Tokenizing, chat, packing, toxicity, quality and the pipeline."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm import bpe, chat, packing, quality, registry, toxicity
from kindred.llm.words import Hasher, buffers, split

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = list("abcXYZ019 .,,..  \n\t!'-é×÷»«…ÀÅß́̊Σσ\x1c\x85\xa0　İK|<>日本​") + ["<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", " the", " of,", "tion", "é,"]


def noise(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(n)))


def test_encoding_equals_the_library():
    rng, own, lib = random.Random(1), bpe.SpeculativeBPE(BYTE), Tokenizer.from_file(BYTE)
    texts = [noise(rng, 60) for _ in range(3000)] + ["x" * 5000, " " * 300, "thequick" * 500, "\n" * 40]
    for text, ids in zip(texts, own.encode_batch(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(text):
    own = bpe.coder(BYTE)
    lib = _lib()
    ids = own.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def _lib(cache=[]):  # noqa: B006
    if not cache:
        cache.append(Tokenizer.from_file(BYTE))
    return cache[0]


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 5)
    rng, own, words, lib = random.Random(3), bpe.SpeculativeBPE(BYTE), packing.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for _ in range(60):
        texts = [noise(rng, 40) for _ in range(6)]
        assert [own.decode(x) for x in own.encode_batch(texts)] == texts
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode_batch([t.encode() for t in texts])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_digests(docs, rows, nothing):
    want = Counter()
    for i, t in rows:
        ids = _lib().encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.encoded_digests(docs, BYTE).collect())) == want
    assert bpe.encoded_digests(nothing, BYTE).count() == 0
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)


def test_packing(spark, docs, rows, nothing):
    lib, cap = Tokenizer.from_file(WORD), 256
    got = packing.pack_documents(docs, WORD, cap).collect()
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), cap)):
            want[(i, k, s, len(ids[s : s + cap]), zlib.crc32(np.array(ids[s : s + cap], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = check_places(got, cap)
    assert filled <= -(-sum(r["length"] for r in got) // cap) * 1.03 + 1
    assert packing.pack_documents(nothing, WORD).count() == 0


def check_places(got, cap):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    """As many bins as the plain method, piece by piece."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(40 - x)
    rows, rank = packing.plan(dict(Counter(lengths)), 40), Counter()
    places = []
    for length, first, count, per, bin_, offset in rows:
        assert first == rank[length]
        rank[length] += count
        places += [{"sequence_id": bin_ + j // per, "offset": offset + j % per * length, "length": length} for j in range(count)]
    assert Counter(p["length"] for p in places) == Counter(lengths)
    assert check_places(places, 40) == len(bins)


def legal(seq):
    last = None
    for r in seq:
        if r not in chat.NEXT[last]:
            return False
        last = r
    return last in (None, "assistant")


def cheapest(roles):
    """Every way to label and merge the turns, with the fewest empty turns between, tried out."""
    best = 0 if not roles else 10**9
    for labels in itertools.product(chat.ROLES, repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=max(0, len(roles) - 1)):
            cost = sum(chat.RELABEL * (a != b) for a, b in zip(roles, labels)) + chat.MERGE * sum(merged)
            seq = [labels[0]] if roles else []
            if any(m and labels[k + 1] != labels[k] for k, m in enumerate(merged)):
                continue
            seq += [x for m, x in zip(merged, labels[1:]) if not m]
            last, ok = None, True
            for r in [*seq, None]:
                gap = None
                for n in range(3):
                    for put in itertools.product(chat.ROLES, repeat=n):
                        run, path = last, True
                        for x in (*put, *([r] if r else [])):
                            path, run = path and x in chat.NEXT[run], x
                        if path and (r or run in (None, "assistant")):
                            gap = n
                            break
                    if gap is not None:
                        break
                if gap is None:
                    ok = False
                    break
                cost, last = cost + chat.INSERT * gap, r
            if ok:
                best = min(best, cost)
    return best


@pytest.mark.parametrize("roles", [[], *([list(p) for n in range(1, 4) for p in itertools.product(["system", "user", "assistant", "tool"], repeat=n)])])
def test_repair_is_cheapest(roles):
    cost, turns, _ = chat.render([(r, "x") for r in roles])
    assert legal([r for r, _ in turns]) and cost == cheapest(roles)


def test_long_conversation():
    """Twenty thousand turns of one role: all but the last are merged into one, in time that grows with their text."""
    cost, turns, text = chat.render([("user", f"line {i}") for i in range(20_000)])
    assert cost == 19_998 * chat.MERGE + chat.RELABEL and [r for r, _ in turns] == ["user", "assistant"]
    assert turns[0][1].split("\n") == [f"line {i}" for i in range(19_999)] and turns[0][1] in text


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, " Assistant", "yes"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 2, "user", None), (3, 0, None, "x"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "user", ""), (5, None, "assistant", "z"), (5, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("r", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["rendered"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n" and got[1]["cost"] == 0
    assert got[2]["rendered"].endswith("<|assistant|>\nb\n<|end|>\n") and got[2]["cost"] == 3
    assert got[4]["n_turns"] == 2 and got[4]["cost"] == chat.RELABEL
    assert got[5]["rendered"].startswith("<|user|>\ny") and {1, 2, 3, 4, 5, None} == set(got)
    assert chat.format_chats(df.where("false")).count() == 0


def test_tree_fit_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = toxicity.fit_trees(x, y)
    assert ((t.margin(x) > 0) == y).mean() > 0.95
    _, p = toxicity.isotonic(t.margin(x), y)
    assert (np.diff(p) > 0).all() and 0 <= p.min() and p.max() <= 1


def test_toxicity_on_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = registry.op5_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    good = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got)
    assert len(got) > 30 and good / len(got) > 0.9 and all(r["predicted"] == (r["score"] >= 0.5) for r in got)


def odd_labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(0, 1, 1), (None, 1, 1), (3, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers_on_odd_rows(spark, docs, nothing):
    labels, none = odd_labels(spark), odd_labels(spark).where("false")
    for y in (labels, none, labels.where("toxic = 1 AND quality = 1")):
        got = toxicity.toxicity(docs, y).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        got = quality.quality(docs, y, F.col("t"), F.lit(None)).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(nothing, labels).count() == quality.quality(nothing, labels, F.col("t"), F.col("n")).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = registry.op8_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.9


def strength(sites):
    """Documents that the prior is worth, from (n, sum, rate above) of each site."""
    many = [(n, s, r) for n, s, r in sites if n > 1]
    if len(many) < 2:
        return 10.0
    var = sum(r * (1 - r) for _, _, r in many) / len(many)
    spread, total, squares = sum(n * (s / n - r) ** 2 for n, s, r in many), sum(n for n, _, _ in many), sum(n * n for n, _, _ in many)
    between = (spread - len(many) * var) / max(1e-9, total - squares / total)
    return min(1000.0, max(1.0, var / between - 1)) if between > 1e-9 else 1000.0


def test_quality_against_plain_loops(spark, monkeypatch):
    """A stub of trees that looks at the number of words; sites and scores by hand."""
    stub = toxicity.Trees(np.array([[0]]), np.array([[np.log1p(3.5)]]), np.array([[-1.5, 1.5]]), 0.0)
    monkeypatch.setattr(quality, "fit", lambda *_: (stub, 0.4))
    rng = random.Random(8)
    rows = [(i, "a b c d e" if rng.random() < rate else "a", host, path) for i, (host, path, rate) in enumerate(
        [("big", "x", 0.9)] * 80 + [("big", "y", 0.2)] * 30 + [("small", "x", 0.1)] * 20 + [("lone", "x", 1.0), ("", "x", 1.0), (None, "x", 0.0), ("big", None, 1.0), ("lone2", "x", 0.0)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r["doc_id"]: r for r in quality.quality(df, odd_labels(spark), F.col("host"), F.col("path")).collect()}
    logit = lambda p: float(np.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4))))
    evidence = {i: 1.5 if len(t.split()) > 3 else -1.5 for i, t, _, _ in rows}
    p = {i: 1 / (1 + np.exp(-(e + np.log(0.4 / 0.6)))) for i, e in evidence.items()}
    paths, hosts = {}, {}
    for i, _, h, q in rows:
        for table, key in ((paths, (h, q)), (hosts, h)):
            n, s = table.get(key, (0, 0.0))
            table[key] = n + 1, s + p[i]
    mean = sum(p.values()) / len(p)
    k = strength([(n, s, mean) for n, s in hosts.values()])
    rate = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    kp = strength([(n, s, rate[h]) for (h, _), (n, s) in paths.items()])
    for i, _, h, q in rows:
        n, s = paths[h, q]
        own = (s - p[i] + kp * rate[h]) / (n - 1 + kp)
        score = 1 / (1 + np.exp(-(evidence[i] + logit(own))))
        assert abs(got[i]["host_rate"] - rate[h]) < 1e-9 and abs(got[i]["path_rate"] - own) < 1e-9 and abs(got[i]["score"] - score) < 1e-9
    far = lambda h: abs(rate[h] - mean) / abs(hosts[h][1] / hosts[h][0] - mean)
    assert far("lone") < far("small") < far("big") < 1  # the fewer documents, the nearer to the corpus


def test_trees_against_plain_loops():
    """One round of depth 1 finds the split that a plain loop finds; the margin adds up leaf by leaf."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=80) > 0.2).astype(float)
    t = toxicity.fit_trees(x, y, rounds=1, depth=1, rate=1.0, least=0.0)
    q = y.mean()
    g, h, best = y - q, q * (1 - q), (0.0, None, None)
    for j in range(3):
        for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])):
            left = x[:, j] <= c
            if left.all() or not left.any():
                continue
            gain = g[left].sum() ** 2 / (h * left.sum() + 1) + g[~left].sum() ** 2 / (h * (~left).sum() + 1) - g.sum() ** 2 / (h * 80 + 1)
            if gain > best[0] + 1e-12:
                best = gain, j, c
    assert (t.feature[0][0], t.cut[0][0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    for side, v in ((left, t.leaf[0][0]), (~left, t.leaf[0][1])):
        assert abs(v - g[side].sum() / (h * side.sum() + 1)) < 1e-9
    plain = [t.base + sum(v[0] if r[f[0]] <= c[0] else v[1] for f, c, v in zip(t.feature, t.cut, t.leaf)) for r in x]
    assert np.allclose(t.margin(x), plain)


def test_isotonic_against_min_max():
    """The pooled value of each row is the greatest, over starts before it, of the least mean up to an end after it."""
    rng = np.random.default_rng(6)
    m, y = np.sort(rng.normal(size=40)), (rng.random(40) < np.linspace(0.1, 0.9, 40)).astype(float)
    at, p = toxicity.isotonic(m, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert sorted(set(np.round(want, 9))) == np.round(p, 9).tolist() and (np.diff(at) > 0).all()


def test_toxic_features():
    lexicon = {b"vile": 2.0, b"dots": 1.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features(b"You VILE one! d.o.t.s v1le far far far far far far vile", lexicon)))
    assert f["hits"] == 2 and f["kinds"] == 1 and f["near"] == 1 and f["joined_hits"] == 2 and f["top_weight"] == 2.0
    assert toxicity.features(b"", lexicon)[1:] == [0.0] * (len(toxicity.FEATURES) - 1)


def test_repeated_ids_bring_one_row_each(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "doc_id", "text", "toxic").collect()
    assert len(got) <= 2 and all(r["text"] in ("text 0", "b") for r in got)


def test_words():
    import pyarrow as pa

    data, off = buffers(pa.array(["Hello  wOrld", None, "\n", " a b", "ab", "hello world ab"]))
    start, end, first = split(data, off)
    got = [[bytes(data[start[k] : end[k]]) for k in range(a, b)] for a, b in zip(first, first[1:])]
    assert got == [[b"Hello", b"wOrld"], [], [], [b"a", b"b"], [b"ab"], [b"hello", b"world", b"ab"]]
    h = Hasher(1, lower=True).words(data, start, end)
    assert h[0] == h[5] and h[1] == h[6] and h[4] == h[7] and len(set(h.tolist())) == 5


def test_pipeline(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    from kindred.llm.shared import shared_dir, stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), shared_dir(spark, "test"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(seen[0]) > len(seen[1]) >= len(seen[2]) == len(seen[3]) > 0.5 * len(seen[0])
    texts = ["".join((t or "").encode().decode().split()) for t in seen[1].values()]
    assert len(set(texts)) == len(texts)
    words = [t.split() for t in seen[3].values()]
    windows = Counter(tuple(w[k : k + 60]) for w in words for k in range(len(w) - 59))
    assert max(windows.values()) == 1
    got = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(seen[3])
    check_places(got, 4096)


def test_every_query_is_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 11))} and set(registry.oracle_sql()) <= names


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, docs, nothing, tmp_path, empty):
    odd_labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    df = (nothing if empty else docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit(None).cast("string"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), df.columns
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, now, str(tmp_path))
        got.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns or name == "packing"
    check_places(now.collect(), 4096)
    assert (now.count() == 0) == empty
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
