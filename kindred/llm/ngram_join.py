"""Similarity join of documents on word n-gram sets by a prefix tree.

Sets are kept in the global order of their 64-bit n-gram hashes; a set and a text go by a key of 128 bits. A set that links shares most of its n-grams, so sets
with too many that no other set has are out at once. Routing of the others: the hash range is cut into one segment more
than the number of elements in which two linked sets of a size class can differ, so linked sets agree in a whole
segment; sets that share segments form families. In each family the sets are stored in a prefix tree, and all sets
probe it at once: a node's n-grams are matched once for every set below it, and a probe leaves a subtree as soon as
its overlap so far and the lengths that remain can't reach the threshold. What arrives at a leaf has its exact overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import Forest, components
from kindred.llm.shared import drop, flagged, left_join_hot, made, quoted, shared_dir, stored, swept, text_key
from kindred.llm.words import Hasher, buffers, mix, parts, split

#: Sets of a family that meet in one task; larger families are cut into blocks, and every two blocks meet.
BLOCK_SETS = 1500
#: Their n-grams at most, about.
BLOCK_GRAMS = 1 << 20
#: Distances between blocks that meet in one round: a round's shuffle holds a set twice as often at most, however many blocks there are.
SHIFTS = 4
#: Cells of the membership table of the probes that descend together.
TABLE_CELLS = 1 << 26
_FIRST, _SECOND = Hasher(3, lower=True), Hasher(4, lower=True)


class Threshold:
    """Jaccard of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def overlap(self, total):
        """Least intersection of two sets whose sizes sum to total."""
        return -(-self.num * total // (self.num + self.den))

    def bands(self, top: int) -> np.ndarray:
        """First sizes of the size classes up to top: linked sets lie in one class or in neighbouring ones."""
        b = [1]
        while b[-1] <= top:
            b.append(-(-b[-1] * self.den // self.num) if b[-1] * self.den // self.num > b[-1] else b[-1] + 1)
        b.append(-(-b[-1] * self.den // self.num) + 1)
        return np.array(b + [-(-b[-1] * self.den // self.num) + 1], np.int64)

    def differing(self, largest):
        """Most elements in which two linked sets of at most this size differ."""
        return 2 * largest * (self.den - self.num) // (self.den + self.num)


def _grams(words: tuple[np.ndarray, ...], n: int, hasher: Hasher) -> np.ndarray:
    """A hash of the n-gram that begins at each word; in a text of fewer words, of the whole text at its first word."""
    data, start, end, first = words
    h = hasher.words(data, start, end)
    g = np.zeros(len(h), np.uint64)
    g[: max(0, len(h) - n + 1)] = hasher.windows(h, n)
    size = np.diff(first)
    for k in range(1, n):
        at = first[:-1][size == k]
        if len(at):
            g[at] = hasher.windows(h, k)[at]
    return g


def _sets(words: tuple[np.ndarray, ...], g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each text's distinct n-grams in rising order of g, offsets)."""
    first, size = words[3], np.diff(words[3])
    count = np.where(size < n, np.minimum(size, 1), size - n + 1)
    of = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    order = np.lexsort((g[at], of))
    of, at = of[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (g[at[1:]] != g[at[:-1]])
    offsets = np.zeros(len(count) + 1, np.int64)
    np.cumsum(np.bincount(of[new], minlength=len(count)), out=offsets[1:])
    return at[new], offsets


def ngram_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): per text its distinct n-grams' hashes, rising; shorter texts are one n-gram, empty ones none."""
    data, off = buffers(text)
    words = (data, *split(data, off))
    g = _grams(words, n, _FIRST)
    at, offsets = _sets(words, g, n)
    return g[at], offsets


def keyed_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What ngram_sets returns, and per text the 16-byte key of its set, from two hashes of different seeds."""
    data, off = buffers(text)
    words = (data, *split(data, off))
    g = _grams(words, n, _FIRST)
    at, offsets = _sets(words, g, n)
    both = np.stack([_keys(g[at], offsets), _keys(_grams(words, n, _SECOND)[at], offsets)], 1)
    return g[at], offsets, pa.Array.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.astype("<u8").tobytes())])


def _segments(h: np.ndarray, off: np.ndarray, size: np.ndarray, t: Threshold, up: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of each segment of each set, in the scheme of its own size class or of the one above.

    Empty segments agree with each other but say nothing. Spare segments make up for a few; a set with more empty
    ones than that sends them too, so that two such sets still meet.
    """
    bands = t.bands(int(size.max(initial=1)))
    k = np.searchsorted(bands, size, "right") - 1 + up
    differ = t.differing(bands[k + 1] - 1)
    spare = differ // 16
    m = differ + 1 + spare
    of = np.repeat(np.arange(len(size)), size)
    seg = ((h >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)
    seg = seg.astype(np.int64)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (seg[1:] != seg[:-1])]))
    total = np.add.reduceat(mix(h), new)
    of, seg = of[new], seg[new]
    full = np.bincount(of, minlength=len(size))
    for i in np.flatnonzero((size > 0) & (m - full > spare)).tolist():
        gone = np.setdiff1d(np.arange(m[i]), seg[of == i])
        of, seg, total = np.concatenate([of, np.full(len(gone), i)]), np.concatenate([seg, gone]), np.concatenate([total, np.zeros(len(gone), np.uint64)])
    return of, mix(total ^ mix((k[of] * 1_000_003 + seg).astype(np.uint64) + np.uint64(77)))


class PrefixTree:
    """A path-compressed trie over sets in global order, in which many probes descend together."""

    def __init__(self, sets: list[np.ndarray], t: Threshold) -> None:
        self.t, self.size = t, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.size)
        token, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1  # an n-gram of one set alone never overlaps
        number = np.cumsum(shared) - 1
        live = shared[at]
        self.tokens = number[at[live]]
        self.of = of[live]
        self.width = max(1, int(shared.sum()))
        self.offset = np.concatenate([[0], np.cumsum(np.bincount(self.of, minlength=len(sets)))])
        self.seqs = [self.tokens[a:b].tolist() for a, b in zip(self.offset, self.offset[1:])]
        self.order = sorted(range(len(sets)), key=self.seqs.__getitem__)
        self.key = self.of * self.width + self.tokens  # rises, as sets and their n-grams do

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, others): each set with the later ones that it links to, exactly; probes go in groups of bounded size."""
        n, step = len(self.seqs), max(1, TABLE_CELLS // self.width)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            has = np.zeros((hi - lo, self.width), bool)
            a, b = self.offset[lo], self.offset[hi]
            has[self.of[a:b] - lo, self.tokens[a:b]] = True
            yield from self._descend(np.arange(lo, hi), has, lo)

    def _descend(self, probes: np.ndarray, has: np.ndarray, base: int) -> Iterator[tuple[int, np.ndarray]]:
        order, seqs, size, t = self.order, self.seqs, self.size, self.t
        shared = np.diff(self.offset)
        none = np.zeros(len(probes), np.int64)
        stack = [(0, len(order), 0, probes, none, none)]
        while stack:
            lo, hi, depth, probe, overlap, passed = stack.pop()
            below = np.array(order[lo:hi])
            first, last = seqs[order[lo]], seqs[order[hi - 1]]
            end, stop = depth, min(len(first), len(last))
            while end < stop and first[end] == last[end]:  # the n-grams that all sets below have next
                end += 1
            if end > depth:
                overlap = overlap + has[np.ix_(probe - base, first[depth:end])].sum(1)
                passed = self._before(probe, first[end - 1])
            small, large = int(size[below].min()), int(size[below].max())
            rest = np.minimum(shared[probe] - passed, int(shared[below].max()) - end)
            fits = (overlap + rest >= t.overlap(size[probe] + small)) & (probe > below.min())
            fits &= (t.den * size[probe] >= t.num * small) & (t.num * size[probe] <= t.den * large)
            probe, overlap, passed = probe[fits], overlap[fits], passed[fits]
            if not len(probe):
                continue
            while lo < hi and len(seqs[order[lo]]) == end:  # sets that end here
                i = order[lo]
                hit = (probe > i) & (overlap >= t.overlap(size[probe] + size[i]))
                if hit.any():
                    yield i, probe[hit]
                lo += 1
            while lo < hi:
                head, a, b = seqs[order[lo]][end], lo + 1, hi
                while a < b:  # the run of sets with the same next n-gram
                    mid = (a + b) // 2
                    a, b = (mid + 1, b) if seqs[order[mid]][end] == head else (a, mid)
                stack.append((lo, a, end, probe, overlap, passed))
                lo = a

    def _before(self, probe: np.ndarray, token: int) -> np.ndarray:
        """How many shared n-grams of each probe come no later than token."""
        return np.searchsorted(self.key, probe * self.width + token, "right") - self.offset[probe]


def _join_cell(sets: list[np.ndarray], block: np.ndarray, pair: bool, t: Threshold, weight: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges that span the links found, linked weight of each set) within one block, or between two."""
    tree, forest, edges, n = PrefixTree(sets, t), Forest(len(sets)), [], np.zeros(len(sets), np.int64)
    for i, others in tree.links():
        if pair:
            others = others[block[others] != block[i]]
        if len(others):
            n[i] += int(weight[others].sum())
            n[others] += weight[i]
            edges += [(i, j) for j in others.tolist() if forest.join(i, j)]
    return edges, n


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, n_links.

    Words are runs of bytes outside 20 and 09 to 0D (hexadecimal), with A-Z in lower case. Rows link when
    den * |intersection| >= num * |union| of their sets of n-word shingles. n_links counts the other rows linked
    directly; component_id is the smallest id reachable, the row's own included. Null and empty texts have no shingles
    and link with nothing; rows with equal sets are looked at once and share their class; a null id is in a class like
    any other but never its smallest; an empty table gives no rows. Other columns are ignored.
    """
    before = len(made)
    return swept(_classified(docs, n, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id", "n_links"), before)


def keep_one(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their class (a null id last, then the least key of the text), with all
    their columns, whatever their names; rows without shingles all stay, and rows repeated with one id and text stay or go together."""
    spark, before = docs.sparkSession, len(made)
    seen = stored(_classified(docs, n, num, den, id_col, text_col), shared_dir(spark, "ngram-rows"))
    best = seen.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("m")).select("m.doc_id", "m.t")
    stay = best.union(seen.where("class IS NULL").select("doc_id", "t"))
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    out = held.join(stay, held["id"].eqNullSafe(stay["doc_id"]) & (held["key"] == stay["t"]), "left_semi")
    return swept(out.select("row.*"), before)


def _classified(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """What ngram_join returns, with the key t of the text and the number of the class (null without shingles)."""
    spark, home, t = docs.sparkSession, shared_dir(docs.sparkSession, "ngrams"), Threshold(num, den)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", text_key("text"))

    share = min(1.0, 2 * (1 - num / den))  # of the hash range, in the first look for sets that may link
    top = _top(share)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            h, off, key = keyed_sets(b.column(2), n)
            low = np.diff(np.searchsorted(np.flatnonzero(h <= top), off))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), key.cast(pa.binary()), _shorts(key), pa.array(np.diff(off)), pa.array(low)], ["doc_id", "t", "key", "short", "n", "n_low"])

    rows = stored(named.select("doc_id", "t", "text").mapInArrow(describe, "doc_id bigint, t binary, key binary, short bigint, n bigint, n_low bigint"), f"{home}/rows")
    once = [F.min(c).alias(c) for c in ("t", "short", "n", "n_low")]
    reps = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), *once)
    reps = stored(reps, f"{home}/reps")
    total = lambda df: df.agg(F.sum("n")).first()[0] or 0
    first = _possible(reps, _credits(named, n, share, total(reps)), F.col("n_low"), t)
    few = flagged(named, first, "t").where("_flag").select("t", "text").dropDuplicates(["t"])
    some = stored(few.join(first, "t"), f"{home}/some")
    near = stored(some.join(_possible(some, _credits(some, n, 1.0, total(some)), F.col("n"), t).select("t"), "t", "left_semi"), f"{home}/near")
    drop(spark, f"{home}/some")
    family = components(_meetings(near, n, t, total(near)))
    families = _families(near, family)
    found = _linked(families, n, t, f"{home}/links")
    drop(spark, f"{home}/near")
    links = components(found.where("v IS NOT NULL").select("u", "v"))
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("w").alias("w"))
    low = reps.join(links, reps["key"] == links["node"], "left").select("key", "low", "copies", F.coalesce("component", "key").alias("c"))
    least = low.groupBy("c").agg(F.min("low").alias("component_id"))
    klass = low.join(least, "c").join(counts, low["key"] == counts["u"], "left").select("key", "c", "component_id", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("links"))
    slim = rows.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"))
    out = left_join_hot(slim, klass, "key", rows.count())
    return out.select("doc_id", "t", F.col("c").alias("class"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _shorts(key: pa.Array) -> pa.Array:
    return pa.array((np.frombuffer(key.buffers()[1], "<u8")[::2] & _SHORT).astype(np.int64))


def _keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    size = np.diff(off)
    key = np.zeros(len(size), np.uint64)
    if len(h):
        key[size > 0] = np.add.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), off[:-1][size > 0])
    return mix(key + size.astype(np.uint64))


#: Bits of a set's key and of a signature that travel. A clash of sets that don't link only puts both into one family; that two
#: that link clash in these 47 bits is taken as impossible. The bit above marks.
_SHORT = np.uint64((1 << 47) - 1)
_MARK = np.uint64(1 << 47)


def _pack(x: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct signatures, least key of each, pairs of another key of a signature with its least)."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    least = key[new][np.cumsum(new) - 1]
    off = key != least
    pairs = np.stack([key[off], least[off]], 1)
    return sig[new], key[new], np.unique(pairs, axis=0) if len(pairs) else pairs


def _top(share: float) -> np.uint64:
    """The end of the lowest share of the hash range."""
    return np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def _buckets(entries: int) -> int:
    """Buckets of about 8 MB: their number follows the data, so that one stays small."""
    return max(64, entries * 12 // (8 << 20))


def _dealt(sig: np.ndarray, key: np.ndarray, buckets: int, extra: tuple[bytes, bytes] | None, seed: int) -> pa.RecordBatch:
    """Rows (bucket, a, b) of packed signatures, which rise, and keys; extra travels under a number below 0."""
    at = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    heads, first = np.unique(at, return_index=True)
    ends = np.append(first[1:], len(at))
    rows = [(int(k), _pack(sig[x:y]), _pack(key[x:y])) for k, x, y in zip(heads, first, ends)]
    if extra:
        rows.append((-1 - seed % buckets, *extra))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["bucket", "a", "b"])


#: Bytes of a bucket's blocks that are joined at once.
HELD = 16 << 20


def _by_bucket(batches: Iterator[pa.RecordBatch], do) -> Iterator[pa.RecordBatch]:
    """Rows of do(bucket, a, b, kept) on the joined blocks of each bucket, which come sorted by it, HELD bytes at once.

    do returns rows and what it must keep of the bucket for its next blocks: one entry per signature, so a frequent one
    fills no worker's memory.
    """
    now, a, b, kept, size = None, [], [], None, 0
    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if a and (bucket != now or size > HELD):
                out, kept = do(now, b"".join(a), b"".join(b), kept)
                yield out
                a, b, size = [], [], 0
            if bucket != now:
                now, kept = bucket, None
            a.append(batch.column(1)[i].as_py())
            b.append(batch.column(2)[i].as_py())
            size += len(a[-1]) + len(b[-1])
    if a:
        yield do(now, b"".join(a), b"".join(b), kept)[0]


def _credits(docs: DataFrame, n: int, share: float, grams: int) -> DataFrame:
    """(short, shared): per short key how many n-grams in the lowest share of the hash range some other set has too.

    An n-gram stands once in the block of each few megabytes of text and bucket, marked if several sets there have it;
    the others get their credit where they are. So one that very many sets have is one entry per block.
    """
    buckets, top = _buckets(int(grams * share)), _top(share)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 0):
            h, off = ngram_sets(b.column(0), n)
            if not len(h):
                continue
            keys = _keys(h, off) & _SHORT
            key, low = np.repeat(keys, np.diff(off)), h <= top
            h, key = h[low], key[low]
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            fresh, other = np.ones(len(h), bool), np.zeros(len(h), bool)
            fresh[1:] = h[1:] != h[:-1]  # the first of its n-gram
            other[1:] = ~fresh[1:] & (key[1:] != key[:-1])  # another set with it
            at = np.flatnonzero(fresh)
            marked = np.add.reduceat(other, at) > 0 if len(at) else np.zeros(0, bool)
            got, count = np.unique(key[other], return_counts=True)
            extra = (_pack(got), _pack(count.astype(np.uint64))) if len(got) else None
            yield _dealt(h[at], np.where(marked, key[at] | _MARK, key[at]), buckets, extra, int(keys[0]))

    def credit(bucket: int, a: bytes, b: bytes, kept) -> tuple[pa.RecordBatch, tuple | None]:
        x, y = _unpack(a), _unpack(b)
        if kept is not None and bucket >= 0:
            x, y = np.concatenate([kept[0], x]), np.concatenate([kept[1], y])
        if bucket < 0:
            got, at = np.unique(x, return_inverse=True)
            count = np.bincount(at, y.astype(np.float64)).astype(np.int64)
        else:
            key = y & _SHORT
            order = np.lexsort((key, x))
            x, y, key = x[order], y[order], key[order]
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            several = np.repeat(np.minimum.reduceat(key, edge) != np.maximum.reduceat(key, edge), np.diff(np.append(edge, len(x))))
            once = np.concatenate([[True], (x[1:] != x[:-1]) | (key[1:] != key[:-1])])
            # equal sets of several blocks count once; if one of them is marked, so is each
            run = np.flatnonzero(once)
            mark = np.maximum.reduceat(y & _MARK, run) > 0
            got, count = np.unique(key[run][several[run] | mark], return_counts=True)
            # of each n-gram one set goes on, marked if several have it; it may get its credit again, which lets it through at worst
            hot = np.maximum.reduceat(np.where(several, _MARK, y & _MARK), edge)
            kept = x[edge], key[edge] | hot
        return pa.RecordBatch.from_arrays([pa.array(got.astype(np.int64)), pa.array(count.astype(np.int64))], ["short", "shared"]), kept

    blocks = docs.select("text").mapInArrow(put, "bucket bigint, a binary, b binary")
    met = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda x: _by_bucket(x, credit), "short bigint, shared bigint")
    return met.groupBy("short").agg(F.sum("shared").alias("shared"))


def _possible(sets: DataFrame, credit: DataFrame, looked_at: Column, t: Threshold) -> DataFrame:
    """(t, key, short, n, copies) of the sets that may link at all.

    A set that links shares at least num/den of its n-grams with one other set; so no more than the rest may lack
    credit. N-grams that weren't looked at have the benefit of the doubt.
    """
    most = F.expr(f"n - ((n * {t.num} + {t.den - 1}) div {t.den})")
    got = sets.select("t", "key", "short", "n", "copies", looked_at.alias("seen")).join(credit, "short", "left")
    return got.where(F.col("seen") - F.coalesce("shared", F.lit(0)) <= most).select("t", "key", "short", "n", "copies")


def _meetings(docs: DataFrame, n: int, t: Threshold, grams: int) -> DataFrame:
    """(u, v): each set's short key with the least of every segment that it shares.

    A signature stands once in a block; the other sets that have it there are tied to that one at once.
    """
    buckets = _buckets(grams * 2 * (t.differing(10_000) + 1) // 10_000)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 0):
            h, off = ngram_sets(b.column(0), n)
            if not len(h):
                continue
            size, keys = np.diff(off), _keys(h, off) & _SHORT
            of, sig = (np.concatenate(x) for x in zip(*(_segments(h, off, size, t, up) for up in (0, 1))))
            sig, key, pairs = _stars(sig, keys[of])
            yield _dealt(sig, key, buckets, (_pack(pairs[:, 0]), _pack(pairs[:, 1])) if len(pairs) else None, int(keys[0]))

    def meet(bucket: int, a: bytes, b: bytes, kept) -> tuple[pa.RecordBatch, tuple | None]:
        x, y = _unpack(a), _unpack(b)
        if bucket < 0:
            pairs = np.stack([x, y], 1)
        else:
            if kept is not None:
                x, y = np.concatenate([kept[0], x]), np.concatenate([kept[1], y])
            *kept, pairs = _stars(x, y)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(np.int64)) for i in (0, 1)], ["u", "v"]), kept

    blocks = docs.select("text").mapInArrow(put, "bucket bigint, a binary, b binary")
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda x: _by_bucket(x, meet), "u bigint, v bigint").distinct()


def _families(near: DataFrame, family: DataFrame) -> DataFrame:
    """near with family, block, blocks: sets of a family of two and more."""
    member = near.join(family, near["short"] == family["node"]).withColumnRenamed("component", "family").drop("node")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    out = member.join(member.groupBy("family").agg(size.alias("blocks")), "family")
    return out.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def _linked(families: DataFrame, n: int, t: Threshold, home: str) -> DataFrame:
    """Edges (u, v) that span the links of each cell, and rows (u, null, w) with a set's linked rows in it, stored in home.

    Families of many blocks take several rounds, each stored before the next, so what is shuffled at once doesn't grow with the
    square of a family. Only their sets are stored for that, with their n-grams.
    """
    put = families.select(F.struct("key", "family", "block", "blocks", "copies").alias("f"), _grams_udf(n)(F.col("text")).alias("grams"))
    most = families.agg(F.max("blocks")).first()[0] or 0
    stored(_cells(put, 0, t), f"{home}/0")
    if most // 2 >= SHIFTS:
        put = stored(put.where(f"f.blocks div 2 >= {SHIFTS}"), f"{home}-grams")
        for low in range(SHIFTS, most // 2 + 1, SHIFTS):
            stored(_cells(put.where(f"f.blocks div 2 >= {low}"), low, t), f"{home}/{low}")
        drop(put.sparkSession, f"{home}-grams")
    return put.sparkSession.read.schema(_LINKS).parquet(*(f"{home}/{low}" for low in range(0, max(1, most // 2 + 1), SHIFTS)))


_LINKS = "u binary, v binary, w bigint"


def _cells(put: DataFrame, low: int, t: Threshold) -> DataFrame:
    """What comes out of the cells of two blocks that lie low to low + SHIFTS - 1 apart, counted around the family's ring of blocks."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            grams = [np.frombuffer(r[4], np.uint64) for r in held]
            block, weight = np.array([r[2] for r in held]), np.array([r[3] for r in held], np.int64)
            edges, w = _join_cell(grams, block, now[1] != now[2], t, weight)
            key = [r[1] for r in held]
            some = np.flatnonzero(w).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([key[i] for i, _ in edges] + [key[i] for i in some], pa.binary()), pa.array([key[j] for _, j in edges] + [None] * len(some), pa.binary()), pa.array([0] * len(edges) + w[some].tolist(), pa.int64())],
                ["u", "v", "w"],
            )

        for b in batches:
            for fam, x, y, key, block, copies, grams in zip(*(c.to_pylist() for c in b.columns)):
                if (fam, x, y) != now:
                    if len(held) > 1:
                        yield done()
                    now, held = (fam, x, y), []
                held.append((fam, key, block, copies, grams))
        if len(held) > 1:
            yield done()

    # from a block forward and back around the ring; half way round both ways lead to one block
    far = F.least(F.lit(low + SHIFTS - 1), F.expr("f.blocks div 2").cast("int"))
    ring = F.transform(F.sequence(F.lit(low), far), lambda s: F.array(*(F.pmod(F.col("f.block") + x, F.col("f.blocks")) for x in (s, -s))))
    spread = put.select("f", "grams", F.explode(F.array_distinct(F.flatten(ring))).alias("o")).select(
        F.col("f.family").alias("family"), F.least("f.block", "o").alias("x"), F.greatest("f.block", "o").alias("y"),
        F.col("f.key").alias("key"), F.col("f.block").alias("block"), F.col("f.copies").alias("copies"), "grams",
    )
    return spread.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(cells, _LINKS)


def _grams_udf(n: int):
    @F.arrow_udf("binary")
    def grams(text: pa.Array) -> pa.Array:
        out = []
        for b in parts(iter([pa.RecordBatch.from_arrays([text], ["t"])]), 0):
            h, off = ngram_sets(b.column(0), n)
            out += [h[x:y].tobytes() for x, y in zip(off, off[1:])]
        return pa.array(out, pa.binary())

    return grams
