"""Ranked lexical search by MaxScore over index shards.

The documents are indexed once for the terms of the queries: a shard is a row that holds the posting lists of some thousand
documents, so that it is read whole, by one task, without a shuffle. Counts over all shards give the weights. Then each
shard answers every query: the terms' greatest contributions in the shard bound what a document can reach; terms whose
bounds together stay under the k-th best score so far are non-essential. Documents come from the essential terms' lists
alone, and the other lists are probed, the strongest first, only for documents that can still qualify. The k best of each
task meet in one ranking per query.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import shared_dir, stored
from kindred.llm.words import LOWER, SIGNS, Hasher, buffers, parts, split

#: A shard ends beyond so many postings or documents; its row has a few megabytes at most.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 16
#: Characters of queries that are answered together, about; more are dealt to blocks, which bounds what is broadcast.
BLOCK_CHARS = 1 << 22
_TERM = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FIRST, _SECOND = Hasher(11), Hasher(12)
_SHARD = "n_docs bigint, n_terms bigint, ids array<bigint>, n array<bigint>, terms array<int>, df array<int>, at array<int>, tf array<int>"


def terms(text: str | None) -> list[bytes]:
    """The terms of one short text, a query."""
    return _TERM.findall((text or "").encode().translate(bytes(LOWER)))


class Vocabulary:
    """Numbers of the queries' terms. A term of eight bytes or fewer is its own key, a longer one has two 64-bit hashes."""

    def __init__(self, words: list[bytes]) -> None:
        self.size = len(words)
        data = np.frombuffer(b" ".join(words), np.uint8)
        end = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        start = end - np.array([len(w) for w in words], np.int64)
        self.short = self._sorted(np.flatnonzero(end - start <= 8), lambda i: self._heads(data, start[i], end[i]))
        long = np.flatnonzero(end - start > 8)
        self.long = self._sorted(long, lambda i: _FIRST.words(data, start[i], end[i]))
        self.check = _SECOND.words(data, start[self.long[1]], end[self.long[1]])

    @staticmethod
    def _heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Runs of eight bytes or fewer as integers; no term has a zero byte, so they are all different."""
        room = np.zeros(len(data) + 8, np.uint8)
        room[: len(data)] = data
        eight = np.ndarray((len(data) + 1,), "<u8", room, 0, (1,))
        return eight[start] & (np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(end - start, 8))).astype(np.uint64))

    @staticmethod
    def _sorted(at: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
        keys = key(at)
        order = np.argsort(keys)
        return keys[order], at[order]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each run of the buffer, -1 for those that aren't in the vocabulary."""
        out = np.full(len(start), -1, np.int64)
        long = end - start > 8
        for at, (keys, ids), key in (
            (np.flatnonzero(~long), self.short, lambda i: self._heads(data, start[i], end[i])),
            (np.flatnonzero(long), self.long, lambda i: _FIRST.words(data, start[i], end[i])),
        ):
            if len(at) and len(keys):
                own = key(at)
                pos = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[pos] == own
                at, pos = at[hit], pos[hit]
                if keys is self.long[0]:
                    same = _SECOND.words(data, start[at], end[at]) == self.check[pos]
                    at, pos = at[same], pos[same]
                out[at] = ids[pos]
        return out


def index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Shards of the documents (doc_id, text): counts of documents with a term and of all terms, and the posting lists of the
    vocabulary's terms, list after list; `at` numbers the shard's documents, whose ids and lengths are given too."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ids, sizes, found, n_docs, n_terms = shipped.value, [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            rows = [np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found)] or [np.empty(0, np.int64)] * 3
            at, term, tf = rows
            order = np.argsort(term, kind="stable")
            names, df = np.unique(term, return_counts=True)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
            lists = [one(pa.concat_arrays(ids) if ids else pa.array([], pa.int64()), None), one(np.concatenate(sizes) if sizes else [], pa.int64())]
            lists += [one(x, pa.int32()) for x in (names, df, at[order], tf[order])]
            return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *lists], ["n_docs", "n_terms", "ids", "n", "terms", "df", "at", "tf"])

        held = postings = 0
        for b in parts(batches, 1):
            data, offsets = buffers(b.column(1))
            data = LOWER[data]
            start, end, first = split(data, offsets, SIGNS)
            size, own = np.diff(first), np.repeat(np.arange(b.num_rows), np.diff(first))
            number = v.numbers(data, start, end)
            known = number >= 0
            pair, tf = np.unique(own[known] * v.size + number[known], return_counts=True)
            doc, term = np.divmod(pair, max(v.size, 1))
            some, at = np.unique(doc, return_inverse=True)  # the documents that any query can meet
            for lo in range(0, len(some), SHARD_DOCS):  # one batch has no more rows than Arrow batches have, but for safety
                mine = (at >= lo) & (at < lo + SHARD_DOCS)
                found.append((at[mine] - lo + held, term[mine], tf[mine]))
                ids.append(b.column(0).take(pa.array(some[lo : lo + SHARD_DOCS])))
                sizes.append(size[some[lo : lo + SHARD_DOCS]])
                held, postings = held + len(sizes[-1]), postings + int(mine.sum())
                if postings >= SHARD_POSTINGS or held >= SHARD_DOCS:
                    yield shard()
                    ids, sizes, found, held, postings, n_docs, n_terms = [], [], [], 0, 0, 0, 0
            n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + int(size.sum())
        if held or n_docs:
            yield shard()

    return docs.mapInArrow(build, _SHARD)


@dataclass
class Best:
    """The k best (score, id) of one query so far; a null id comes after the others."""

    k: int
    score: np.ndarray
    id_: np.ndarray
    null: np.ndarray

    @property
    def least(self) -> int:
        """What a document must reach to count: the k-th best score, or anything above 0."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        score, id_, null = np.concatenate([self.score, score]), np.concatenate([self.id_, id_]), np.concatenate([self.null, null])
        if len(score) > self.k:
            top = score >= np.partition(score, -self.k)[-self.k]
            score, id_, null = score[top], id_[top], null[top]
        order = np.lexsort((id_, null, -score))[: self.k]
        self.score, self.id_, self.null = score[order], id_[order], null[order]


class Shard:
    """Posting lists with their contributions, and the greatest of each list."""

    def __init__(self, row: dict[str, np.ndarray], weight: np.ndarray, n: int, length: int) -> None:
        begin = np.concatenate([[0], np.cumsum(row["df"], dtype=np.int64)])
        m = 75 + 25 * row["n"] * n // max(length, 1)
        tf = row["tf"].astype(np.int64)
        gain = np.repeat(weight[row["terms"]], row["df"]) * (1_000_000_000 * tf // (1000 * tf + 12 * m[row["at"]]))
        self.size, self.looked = len(row["n"]), 0
        self.lists = {t: (row["at"][a:b], gain[a:b]) for t, a, b in zip(row["terms"].tolist(), begin[:-1].tolist(), begin[1:].tolist())}
        self.bound = dict(zip(row["terms"].tolist(), np.maximum.reduceat(gain, begin[:-1]).tolist())) if len(gain) else {}

    def search(self, query: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that reach `least`; query: (term, repeats). `looked` counts the postings read."""
        mine = sorted((self.bound[t] * r, t, r) for t, r in query if self.bound.get(t, 0) > 0)
        reach = np.cumsum([x[0] for x in mine], dtype=np.int64)  # what the lists up to each one can add up to
        first = int(np.searchsorted(reach, least))
        if first == len(mine):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        score = np.zeros(self.size, np.int64)
        for _, t, r in mine[first:]:
            at, gain = self.lists[t]
            score[at] += gain * r
            self.looked += len(at)
        docs = np.flatnonzero(score)
        score = score[docs]
        for i in range(first - 1, -1, -1):
            live = score + reach[i] >= least
            docs, score = docs[live], score[live]
            at, gain = self.lists[mine[i][1]]
            pos = np.minimum(np.searchsorted(at, docs), len(at) - 1)
            hit = at[pos] == docs
            score[hit] += gain[pos[hit]] * mine[i][2]
            self.looked += len(docs)
        top = score >= least
        return docs[top], score[top]


def _answer(shards: DataFrame, queries: list[tuple[int, object, list[tuple[int, int]]]], weight: np.ndarray, n: int, length: int, k: int, kind: str) -> DataFrame:
    """(q, item_id, doc_id, score): the k best of each query in each partition of the shards."""
    shipped = shards.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, w = shipped.value
        best = [Best(k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in qs]
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].values for name in ("ids", "n", "terms", "df", "at", "tf")}
                ids = row.pop("ids")
                null, ids = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy(False)
                shard = Shard({c: x.to_numpy(False) for c, x in row.items()}, w, n, length)
                for (_, _, query), top in zip(qs, best):
                    docs, score = shard.search(query, top.least)
                    if len(docs):
                        top.add(score, ids[docs], null[docs])
        sizes = [len(top.score) for top in best]
        item = pa.array([q[1] for q, size in zip(qs, sizes) for _ in range(size)], out_type)
        cat = lambda c: np.concatenate([getattr(top, c) for top in best]) if best else []
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q[0] for q in qs], sizes), pa.int64()), item, pa.array(cat("id_"), pa.int64(), mask=np.array(cat("null"), bool)), pa.array(cat("score"), pa.int64())], ["q", "item_id", "doc_id", "score"])

    out_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return shards.select("ids", "n", "terms", "df", "at", "tf").mapInArrow(run, f"q bigint, item_id {kind}, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of items.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term's weight grows with its rarity, its
    contribution with its frequency in a document, less in long ones; repeats in the query count each. Null and empty texts
    have no terms, neither match nor count as documents. Equal scores go by the smaller id, a null id last; repeated rows
    of docs are documents of their own, repeated rows of items are answered each. An empty table on either side gives
    no rows; other columns are ignored, whatever their names.
    """
    spark, home = docs.sparkSession, shared_dir(docs.sparkSession, "search")
    kind = dict(items.dtypes)[item_col]
    kind = kind if kind in ("bigint", "int") else "string"
    asked = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).cast(kind).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    asked = stored(asked, f"{home}/items")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = -(-chars // BLOCK_CHARS) or 1, None
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).orderBy("q").collect()  # one block of queries
        words = [Counter(terms(r["text"])) for r in rows]
        number = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        shards = stored(index(slim, Vocabulary(list(number))), f"{home}/shards-{block}")
        n, length = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        each = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
        df = np.zeros(len(number), np.int64)
        for r in each.collect():  # no more than the block's terms
            df[r["terms"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * x + 1))) for x in df.tolist()], np.int64)
        queries = [(r["q"], r["item_id"], [(number[w], m) for w, m in ws.items()]) for r, ws in zip(rows, words)]
        got = _answer(shards, queries, weight, n, length, k, kind)
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
