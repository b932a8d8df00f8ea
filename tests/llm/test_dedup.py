"""Exact, near, substring, line and vector deduplication against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import components, embedding_dedup, exact_dedup, line_dedup, ngram_join, registry, substring_dedup
from kindred.llm.shared import FREE, stored
from tests.llm.conftest import WHITE
from tests.oracle import agree

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def norm(t):
    return (t or "").encode().translate(None, WHITE)


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, t))
    want = Counter()
    for n, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(n).hexdigest()
        for k, r in enumerate(sorted(g, key=lambda r: r != best)):
            want[(r[0], best[0], len(g), k == 0, sha)] += 1
    return want


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.substring(exact_dedup.sha256(n), 1, 1)])
def test_exact(docs, rows, digest):
    """The second digest makes different texts collide, so the bytes must decide."""
    assert bag(exact_dedup.exact_dedup(docs, digest=digest), *COLS) == exact_expected(rows)


def test_exact_in_many_batches(docs, rows):
    assert bag(exact_dedup.exact_dedup(docs, files_per_batch=1), *COLS) == exact_expected(rows)


def test_exact_goes_on_with_its_state(spark, rows, tmp_path):
    """Two lots fed one after the other, the second by another session, give the answer of both."""
    half = len(rows) // 2
    for k, some in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(some, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/lot{k}")
    state = f"file://{tmp_path}/state"
    first = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/lot0"), state=state)
    assert bag(first, *COLS) == exact_expected(rows[:half])
    other = spark.newSession()
    second = exact_dedup.exact_dedup(other.read.parquet(f"{tmp_path}/lot1"), state=state)
    assert bag(second, *COLS) == exact_expected(rows)


def test_exact_lots_that_die_and_odd_paths(spark, rows, tmp_path, monkeypatch):
    """A lot that dies, while its stream runs or before its mark, and is given again counts once; paths have any characters."""
    third = len(rows) // 3
    lots = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    paths = [f"{tmp_path}/{x}" for x in ("lot 0%41", "lot#1+?", "lot [2] é")]
    for path, some in zip(paths, lots):
        spark.createDataFrame(some, "doc_id long, text string").repartition(3).write.parquet(path.replace("?", "q"))
    read = lambda k: spark.read.parquet(paths[k].replace("?", "q").replace("[", "\\[").replace("]", "\\]"))
    state = f"file://{tmp_path}/state"
    assert bag(exact_dedup.exact_dedup(read(0), state=state), *COLS) == exact_expected(lots[0])

    def die(*a, **k):
        raise RuntimeError("driver lost")

    for name, where in (("_feed", exact_dedup), ("mark", exact_dedup.Lots)):
        with monkeypatch.context() as m:
            m.setattr(where, name, die)
            with pytest.raises(RuntimeError):
                exact_dedup.exact_dedup(read(1), state=state)
    assert bag(exact_dedup.exact_dedup(read(1), state=state), *COLS) == exact_expected(lots[0] + lots[1])
    assert bag(exact_dedup.exact_dedup(read(1), state=state), *COLS) == exact_expected(lots[0] + lots[1])  # the same lot again
    own = bag(exact_dedup.exact_dedup(read(2), state=state, new_only=True), "doc_id", "group_size", "text_sha256")
    every = [(n[0], n[2], n[4]) for n in exact_expected(rows).elements()]
    ids = {i for i, _ in lots[2]}
    assert sum(own.values()) == len(lots[2]) and not own - Counter(x for x in every if x[0] in ids)
    assert bag(exact_dedup.exact_dedup(read(2), state=state, new_only=True), "doc_id", "group_size", "text_sha256") == own
    weak = lambda c: F.substring(exact_dedup.sha256(c), 1, 1)  # noqa: E731  texts that share a digest
    other = f"file://{tmp_path}/weak"
    for k in range(3):
        got = exact_dedup.exact_dedup(read(k), state=other, digest=weak)
        assert bag(got, *COLS) == exact_expected(sum(lots[: k + 1], []))


def test_operators_at_once(spark, sf_dir):
    """Operators of one driver leave each other's tables alone, and a call the results of earlier ones."""
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline

    small = sf_dir.replace("sf0.01", "sf0.001")
    ops = ["op3_ngram_join", "op6_substring_dedup", "op7_embedding_dedup"]
    run = lambda name: Counter(map(tuple, registry.queries()[name](spark, small).collect()))
    with ThreadPoolExecutor(3) as pool:
        at_once = list(pool.map(run, ops))
    assert at_once == [run(name) for name in ops]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    even, odd = (docs.where(F.col("doc_id") % 2 == k) for k in (0, 1))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats):
        a = stage(spark, even, small)
        b = stage(spark, odd, small)
        assert 0 < b.count() <= odd.count() and 0 < a.count() <= even.count()


def test_exact_keeps_one(docs, rows, nothing):
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    want = {(n[0], n[4]) for n in exact_expected(rows) if n[3]}
    assert Counter((r["doc_id"], hashlib.sha256(norm(r["text"])).hexdigest()) for r in got.collect()) == Counter(want)
    assert exact_dedup.keep_one(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, sf_dir, name):
    agree(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])


def shingles(t, n):
    w = (t or "").encode().translate(LOWER).split()
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def joined(rows, n, num, den):
    s = [shingles(t, n) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    low = {}
    for r, (i, _) in zip(root, rows):
        low[r] = min(x for x in (low.get(r), i, 10**9) if x is not None)
    out = Counter()
    for k, (i, t) in enumerate(rows):
        out[(i, len(s[k]), None if low[root[k]] == 10**9 else low[root[k]], links[k])] += 1
    return out


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_ngram_join(docs, rows, n, num, den):
    got = bag(ngram_join.ngram_join(docs, n, num, den), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == joined(rows, n, num, den)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (1, 80, 100), (2, 60, 100)])
def test_ngram_join_of_short_texts(spark, n, num, den):
    """Sets of few n-grams, most with a word of their own."""
    rng, rows = random.Random(n), []
    for i in range(60):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 26))]
        for j in range(4):
            v = list(w)
            if j:
                v[rng.choice([0, -1, rng.randrange(len(v))])] = f"own{i}x{j}"
            rows.append((i * 10 + j, " ".join(v + ["more"] * (j == 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = joined(rows, n, num, den)
    assert max(k[3] for k in want) > 0
    assert bag(ngram_join.ngram_join(df, n, num, den), "doc_id", "n_shingles", "component_id", "n_links") == want


def test_ngram_join_in_blocks(docs, rows, monkeypatch):
    """Small blocks of sets, and buckets joined a few entries at once."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "HELD", 500)
    assert bag(ngram_join.ngram_join(docs, 3, 70, 100), "doc_id", "n_shingles", "component_id", "n_links") == joined(rows, 3, 70, 100)


@pytest.mark.parametrize("shifts", [2, 4])
def test_ngram_join_in_rounds(spark, monkeypatch, shifts):
    """A family of many blocks is shuffled a few times over in each round, not once for every block; even and odd rings of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "SHIFTS", shifts, raising=False)
    rng, rows = random.Random(8), []
    for of, n in ((0, 120), (1, 37), (2, 9), (3, 2)):
        base = [f"w{of}x{rng.randrange(500)}" for _ in range(60)]
        for j in range(n):
            w = list(base)
            w[rng.randrange(len(w))] = f"own{of}x{j}"
            rows.append((1000 * of + j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, kind, real = [], type(df), type(df).repartition

    def repartition(self, *by):
        if by[0] == "family":
            dealt.append(self.count())
        return real(self, *by)

    monkeypatch.setattr(kind, "repartition", repartition)
    got = bag(ngram_join.ngram_join(df, 3, 80, 100), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == joined(rows, 3, 80, 100)
    assert max(dealt) <= 2 * shifts * len(rows)


def test_ngram_join_keeps_one(docs, rows, nothing):
    got = ngram_join.keep_one(docs, 5, 80, 100)
    assert got.columns == docs.columns
    want = joined(rows, 5, 80, 100)
    ids = {k[0] for k in want if k[0] is not None and (k[1] == 0 or k[2] == k[0])}
    assert {r["doc_id"] for r in got.collect()} - {None} == ids
    assert ngram_join.ngram_join(nothing).count() == 0


def test_prefix_tree_and_segments():
    rng, t = random.Random(3), ngram_join.Threshold(80, 100)
    base = [np.array([rng.getrandbits(63) for _ in range(rng.randrange(1, 90))], np.uint64) for _ in range(12)]
    sets = []
    for _ in range(160):
        b = rng.choice(base)
        keep = b[np.array([rng.random() > 0.08 for _ in b], bool)]
        sets.append(np.unique(np.concatenate([keep, np.array([rng.getrandbits(63) for _ in range(rng.randrange(4))], np.uint64)])))
    sets = [s for s in sets if len(s)]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert want and {(i, j) for i, o in ngram_join.PrefixTree(sets, t).links() for j in o.tolist()} == want
    spread = [ngram_join.mix(s) for s in sets]
    size, off = np.array([len(s) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    mine = [set() for _ in sets]
    for up in (0, 1):
        for i, s in zip(*(x.tolist() for x in ngram_join._segments(np.concatenate([np.sort(x) for x in spread]), off, size, t, up))):
            mine[i].add(s)
    assert all(mine[i] & mine[j] for i, j in want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7), (500, 500)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e for e in edges if e[0] != e[1])}


def cut_expected(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    return out


@pytest.mark.parametrize("window", [35, 7, 80])
def test_substrings(docs, rows, window):
    got = substring_dedup.substring_dedup(docs, window)
    assert got.columns == [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")] + ["kept_text", "n_words", "n_removed"]
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_text") == cut_expected(rows, window)


def test_substrings_of_nothing(nothing):
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    rng = random.Random(2)
    for _ in range(4000):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(12))) for _ in range(2))
        b = a[: rng.randrange(12)] + b[:2] + a[rng.randrange(12) :] if rng.random() < 0.7 else b
        for most in range(4):
            assert line_dedup.edit_distance(a, b, most) == min(plain(a, b), most + 1)


def word_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def near_lines(rng):
    """Lines of 1 to 250 words with copies that have up to one edit for eight words, spread or in one place."""
    vocabulary, out = [rng.choice("th er on an in".split()) + rng.choice("abcdefgh") + rng.choice(["", "é", "—"]) for _ in range(60)], []
    for n in [rng.randrange(1, 40) for _ in range(40)] + [rng.randrange(40, 250) for _ in range(12)]:
        line = [rng.choice(vocabulary) for _ in range(n)]
        out.append(line)
        for _ in range(4):
            s, step = list(line), rng.randrange(8, 14)
            for k in range(rng.randrange(step), len(s), step):
                s[k] = rng.choice(["", "new", s[k] + " more"])
            out.append(" ".join(s).split())
        k = rng.randrange(n)
        out.append(line[:k] + line[k + n // rng.randrange(8, 14) :])
    return [" ".join(x) for x in out if x]


def near_pairs(lines):
    """Pairs of different lines that brute force links."""
    words, out = [tuple(re.findall("[\u0800-\U0010ffff]|[^ \t\r\v\f\u0800-\U0010ffff]+", x)) for x in lines], set()
    for i, x in enumerate(words):
        for j, y in enumerate(words[:i]):
            most = max(len(x), len(y)) // 10
            if x != y and abs(len(x) - len(y)) <= most and word_distance(x, y) <= most:
                out.add((j, i))
    return words, out


def lines_expected(rows):
    """Rows (id, n_lines, n_dropped, kept_text), by all pairs of lines."""
    split = [[x.strip(" \t\r\v\f") for x in (t or "").split("\n") if x.strip(" \t\r\v\f")] for _, t in rows]
    distinct = sorted({x for v in split for x in v})
    words, near = near_pairs(distinct)
    root = list(range(len(distinct)))
    same = {(i, j) for j in range(len(distinct)) for i in range(j) if words[i] == words[j]}
    for i, j in near | same:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    klass = dict(zip(distinct, root))
    seen, want = set(), Counter()
    for (i, _), v in zip(rows, split):
        kept = []
        for x in v:
            if klass[x] not in seen:
                kept.append(x)
                seen.add(klass[x])
        want[(i, len(v), len(v) - len(kept), "\n".join(kept))] += 1
    return want


@pytest.mark.parametrize("block", [1 << 25, 4000])
def test_lines(spark, docs, nothing, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "CELL_ROWS", 5 if block < 10**6 else 8192)  # lines under one anchor in several cells
    rng = random.Random(9)
    long = near_lines(rng)[5].split() * 3
    crowd = [" ".join("odd" if k in (i % len(long), i * 7 % len(long)) else w for k, w in enumerate(long)) for i in range(60)]
    pool = crowd + near_lines(rng) + ["  two  words ", "two words", "\ttwo\vwords", "x" * 3000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(70)] + [(90, None), (91, ""), (92, "\n \n"), (None, pool[0] + "\r\n" + pool[1])]
    want = lines_expected(rows)
    assert sum(k[2] for k in want) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).repartition(4)
    assert bag(line_dedup.line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_text") == want
    assert line_dedup.line_dedup(nothing).count() == 0
    assert line_dedup.line_dedup(docs).count() == docs.count()


def test_anchors_find_every_near_pair():
    lines = sorted(set(near_lines(random.Random(5))))
    p = line_dedup._Lines(pa.array(lines))
    name = {int(h & line_dedup._SHORT): i for i, h in enumerate(p.hashes(line_dedup._FIRST)[1])}
    assert len(name) == len(lines)
    entries = line_dedup.entries(p)[1]
    found = {tuple(sorted((name[int(u)], name[int(v)]))) for u, v in line_dedup._meet(entries, entries, few=10**6)[0]}
    words, want = near_pairs(lines)
    assert [tuple(line_dedup.words(x.encode())) for x in lines] == [tuple(w.encode() for w in x) for x in words]
    assert len(want) > 100 and want <= found, sorted(want - found)[:3]
    assert len(found) < len(lines) ** 2 / 20  # a few copies of each line, not all pairs


def thue_morse():
    """Two words of 1024 bytes whose polynomial hashes modulo 2^64 are equal, whatever the base."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_stay_apart(spark):
    a, b = thue_morse()
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert bag(ngram_join.ngram_join(df), "doc_id", "component_id", "n_links") == Counter([(1, 1, 0), (2, 2, 0)])
    assert bag(line_dedup.line_dedup(df), "doc_id", "n_dropped") == Counter([(1, 0), (2, 0)])
    long = spark.createDataFrame([(i, " ".join([f"x{j}" for j in range(17)] + [w] + [f"y{j}" for j in range(17)])) for i, w in enumerate((a, b))], "doc_id long, text string")
    assert bag(substring_dedup.substring_dedup(long), "doc_id", "n_removed") == Counter([(0, 0), (1, 0)])
    words = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((a, b))], "doc_id long, text string")
    assert bag(substring_dedup.substring_dedup(words, 1024), "doc_id", "n_removed") == Counter([(0, 0), (1, 0)])


def vectors(rng):
    out = []
    for i in range(150):
        b = [rng.gauss(0, 1) for _ in range(8)] if i < 40 else [x + rng.gauss(0, 0.18) for x in out[rng.randrange(40)][1]]
        out.append((i, b, i % 3))
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, out[0][1], None), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [1e200, 1e200], 1), (208, [], 1), (209, [float("inf"), 1.0], 1)]
    return out + odd + [(300 + i, out[3][1], 0) for i in range(5)] + [(301, out[3][1], 0), (None, out[3][1], 0)]


@pytest.mark.parametrize("block", [10_000, 20])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_VECTORS", block)
    rows = vectors(random.Random(4))
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if fine(v) else None for _, v, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93:
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    want = Counter()
    for k, (i, _, _) in enumerate(rows):
        low = min((rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None), default=None)
        want[(i, links[k], low, low == i and i is not None)] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).repartition(4)
    assert bag(embedding_dedup.embedding_dedup(df), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0


def test_dual_traversal_looks_at_few_pairs():
    """Two trees of 40 tight clusters: all links, by far fewer cosines than there are pairs; and vectors without any structure."""
    rng = np.random.default_rng(3)
    for spread, most in ((0.02, 0.1), (3.0, 1.2)):
        centre = rng.normal(size=(40, 16))
        a, b = (np.repeat(centre, 30, 0) + spread * rng.normal(size=(1200, 16)) for _ in range(2))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b[:700]))
        ta, tb = embedding_dedup.CoverTree(a), embedding_dedup.CoverTree(b)
        for x, y, tx, ty in ((a, b, ta, tb), (a, a, ta, ta)):
            count = []
            got = {(int(tx.order[i]), int(ty.order[j])) for i, j in embedding_dedup.dual_links(tx, ty, 0.93, count) for i, j in zip(i, j)}
            want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ y.T >= 0.93))}
            if x is y:
                got, want = {(min(p), max(p)) for p in got}, {p for p in want if p[0] < p[1]}
            assert got == want and sum(count) < most * len(x) * len(y)
    for n in (2000, 6000):  # without any structure: nets, traversal and all
        x = rng.normal(size=(n, 64))
        t = embedding_dedup.CoverTree(x / np.linalg.norm(x, axis=1, keepdims=True))
        count = []
        assert not any(len(i) for i, _ in embedding_dedup.dual_links(t, t, 0.93, count))
        assert t.cosines + sum(count) < 0.8 * n * n


def test_a_class_of_many_blocks(spark, monkeypatch):
    """A class cut into blocks that all meet, beside small ones: as by all pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_VECTORS", 40)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 8))
    x = np.repeat(centre, 20, 0) + 0.12 * rng.normal(size=(600, 8))
    label = np.where(rng.random(600) < 0.8, 0, rng.integers(1, 4, 600))
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(600, dtype=bool)
    low = np.arange(600)
    for _ in range(600):
        new = np.minimum(low, np.where(link, low, 600).min(1))
        if (new == low).all():
            break
        low = new
    assert got == {i: (int(link[i].sum()), int(low[i])) for i in range(600)}


def test_sketches_keep_all_pairs_within_the_edits():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "漢", "字"]
    for _ in range(200):
        a = rng.choices(vocabulary, k=rng.randint(10, 80))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 10)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        p = line_dedup._Lines(pa.array([" ".join(a), "", " ".join(b)]))
        x, y = p.sketches(np.array([0, 1]))
        distance = line_dedup.edit_distance(a, b, len(a))
        assert np.bitwise_count(x ^ y).sum() <= 2 * distance
        if distance <= max(len(a), len(b)) // line_dedup.WORDS_AN_EDIT:
            assert line_dedup._alike(x[None], y[None], np.array([max(len(a), len(b))]))[0]


def test_near_pairs_agree_with_the_distance_of_each():
    rng, a, b = random.Random(3), [], []
    for _ in range(3000):
        x = rng.choices("abcdefghijklmnop", k=rng.choice([1, 5, 9, 10, 25, 60, 150, 319, 400]))
        y = list(x)
        for _ in range(rng.randint(0, len(x) // 8 + 1)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 2)] = rng.choices("abcdefghijklmnop", k=rng.randint(0, 2))
        y = y or ["a"]
        x, y = rng.choice([(x, y), (y, x)])
        a.append(" ".join(x).encode())
        b.append(" ".join(y).encode())
    most = [max(len(x.split()), len(y.split())) // line_dedup.WORDS_AN_EDIT for x, y in zip(a, b)]
    want = [line_dedup.edit_distance(x.split(), y.split(), k) <= k for x, y, k in zip(a, b, most)]
    got = line_dedup.near_pairs(a, b).tolist()
    assert got == want and 0.2 < sum(got) / len(got) < 0.9
    assert line_dedup.near_pairs([], []).tolist() == []


def test_pairs_between_classes():
    """Ranges of places leave out no two lines of different classes whose segments and windows fit one by one."""
    rng, kept = np.random.default_rng(4), 0
    for _ in range(120):
        n = 80
        ident = rng.integers(0, 30, n)
        size = rng.integers(20, 60, 30)[ident]
        key, probe, place, label = rng.integers(0, 3, n), rng.random(n) < 0.5, rng.integers(0, 20, n), ident % 7
        row = np.empty(n, [("size", "<u2"), ("place", "<u2")])
        row["size"], row["place"] = size, place
        want = set()
        for i in np.flatnonzero(~probe):
            for j in np.flatnonzero(probe & (key == key[i]) & (label != label[i]) & (size >= size[i])):
                if line_dedup._fits(row[i : i + 1], row[j : j + 1])[0]:
                    want.add((min(ident[i], ident[j]), max(ident[i], ident[j])))
        groups = {}
        for i in range(n):
            groups.setdefault((key[i], ident[i], size[i], probe[i]), []).append(place[i])
        k, who, s, p = (np.array(x) for x in zip(*groups))
        low, high = np.array([min(x) for x in groups.values()]), np.array([max(x) for x in groups.values()])
        got = set(map(tuple, line_dedup._across(k, who, s, p, low, high, who % 7, np.zeros((len(k), 4), np.uint64), np.ones(len(k), bool)).tolist()))
        assert want <= got
        kept += len(want)
    assert kept > 500


def test_lines_that_repeat_a_phrase(spark):
    rng = random.Random(11)
    base = ["so it goes"] * 60 + [f"w{i}" for i in range(20)]
    pool = []
    for i in range(40):
        line = " ".join(rng.sample(base, len(base))).split() if i % 4 == 0 else pool[-1].split()
        for _ in range(rng.randrange(30)):
            line[rng.randrange(len(line))] = f"x{rng.randrange(1000)}"
        pool.append(" ".join(line))
    rows = [(i, "\n".join(rng.sample(pool, 2))) for i in range(60)]
    assert bag(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_lines", "n_dropped", "kept_text") == lines_expected(rows)


def test_stored_leaves_no_shuffle_files(spark, tmp_path):
    """Otherwise every shuffle of a stage lies on disk until the driver happens to collect garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {n for f in disk.getAllFiles().toString().split("/") if (n := f.split(",")[0].rstrip(")")).startswith("shuffle_")}
    before, was = there(), spark.conf.get(FREE, "false")
    wide = spark.range(20_000).select((F.col("id") % 997).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    got = stored(wide.repartition(7, "k").join(wide.groupBy("k").agg(F.max("t").alias("m")).repartition(7, "k"), "k"), str(tmp_path / "t"))
    for _ in range(100):
        if not there() - before:
            break
        time.sleep(0.1)
    assert not there() - before and got.count() == 20_000 and spark.conf.get(FREE, "false") == was


def test_wide_sketches_keep_pairs_within_the_edits_and_few_others():
    """Long lines of few words differ in most bits of what is allowed only if they are near; no pair within the edits is lost."""
    rng, lost, seen = random.Random(6), 0, 0
    lines = []
    for n in (33, 90, 300, 700):
        base = [rng.choice("the and of to in on".split()) if rng.random() < 0.7 else f"w{rng.randrange(500)}" for _ in range(n)]
        for share in (0.03, 0.08, 0.11, 0.25, 0.3, 0.4):
            s = list(base)
            for _ in range(int(share * n)):
                s[rng.randrange(len(s))] = rng.choice(["", "the", "of and", f"x{rng.randrange(10**6)}"])
            lines.append(" ".join(s).split())
        lines.append(base)
    p = line_dedup._Lines(pa.array([" ".join(x) for x in lines]))
    wide = p.wide(np.arange(len(lines)))
    i, j = np.triu_indices(len(lines), 1)
    swap = p.size[i] > p.size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    differ = line_dedup.differing([np.frombuffer(x, "<u8") for x in wide], i, j)
    most, more, near = p.size[j] // line_dedup.WORDS_AN_EDIT, p.size[j] - p.size[i], 0
    for x, y, d, k, m in zip(i.tolist(), j.tolist(), differ.tolist(), most.tolist(), more.tolist()):
        if m <= k and line_dedup.edit_distance(lines[x], lines[y], k) <= k:
            near += 1
            assert d <= 2 * k - m
    assert near > 8
    n, zero = len(lines), np.zeros(len(lines), np.int64)
    probe, ident, void = np.arange(n) % 2 == 1, np.arange(n), np.zeros((n, 4), np.uint64)
    args = zero, ident, p.size, probe, zero, zero, ident, void, np.ones(n, bool)
    plain, sifted = line_dedup._across(*args), line_dedup._across(*args, wide)
    assert len(sifted) < len(plain) / 2 and set(map(tuple, sifted.tolist())) <= set(map(tuple, plain.tolist()))


def test_components_of_dense_edges_become_trees(spark, monkeypatch):
    """However many tasks the edges of a dense component are dealt to, the rounds work on about one edge a node."""
    rounds, real = [], components.stored

    def stored(df, path):
        out = real(df, path)
        rounds.append(out.count())
        return out

    monkeypatch.setattr(components, "stored", stored)
    edges = spark.range(300 * 300).select((F.col("id") % 300).alias("u"), F.floor(F.col("id") / 300).alias("v")).where("u < v AND (u + v) % 7 = 0")
    with_tasks = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = components.components(edges).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_tasks)
    assert rounds[1] < 300
    assert {(r["node"], r["component"]) for r in got} == {(x, min(x % 7, -x % 7) or (0 if x % 7 == 0 else 7)) for x in range(300)}
