"""Byte-level BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens of the vocabulary. A cut is the encoding of the word exactly if
each token encodes itself and each adjacent pair encodes itself; the pairs of a whole batch are gathered in one
array, and its distinct values are looked up in a table of verdicts. Only words with a failing pair are merged rule by rule.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import Recent

#: Splits a text before any merge (fixed value: the published pattern of byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's table before it starts afresh.
CACHE_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.id_of = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rule = {}
        for rank, (a, b) in enumerate(pairs):
            x, y = to_bytes(a), to_bytes(b)
            self.rule.setdefault((self.id_of[x], self.id_of[y]), (rank, self.id_of[x + y]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.width = max(self.bytes_of) + 1
        self.reach: dict[bytes, int] = {}  # longest token that begins with two given bytes
        for b in self.id_of:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 0), len(b))
        self.verdict: dict[int, bool] = {}
        self.known = Recent(CACHE_WORDS)

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rule first, leftmost first, over a linked list with a heap."""
        n, rule = len(ids), self.rule
        if n <= 20:  # short words need no heap
            ids, none = list(ids), (1 << 60, 0)
            while n > 1:
                rules = [rule.get(p, none) for p in zip(ids, ids[1:])]
                best = min(rules)
                if best is none:
                    break
                i = rules.index(best)
                ids[i : i + 2] = [best[1]]
                n -= 1
            return ids
        ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rule.get((a, b)))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                if r := rule.get((new, ids[right[i]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[right[i]]))
            if left[i] >= 0 and (r := rule.get((ids[left[i]], new))):
                heapq.heappush(heap, (r[0], left[i], r[1], ids[left[i]], new))
        return [x for x in ids if x >= 0]

    def exact(self, word: bytes) -> list[int]:
        return self.merge([self.id_of[word[i : i + 1]] for i in range(len(word))])

    def propose(self, word: bytes) -> list[int]:
        """Longest tokens from the left."""
        out, i, n, get, reach = [], 0, len(word), self.id_of.get, self.reach.get
        while i < n:
            for k in range(min(n - i, reach(word[i : i + 2], 1)), 0, -1):
                if (t := get(word[i : i + k])) is not None:
                    break
            out.append(t)
            i += k
        return out

    def stands(self, key: int) -> bool:
        """Whether a pair of tokens, or a single one (then the first is the width itself), encodes itself."""
        a, b = divmod(key, self.width)
        if a == self.width:
            return self.exact(self.bytes_of[b]) == [b]
        return self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def learn(self, words: list[str]) -> None:
        """Puts the words' encodings into the table."""
        raw = [w.encode() for w in words]
        cut = [self.propose(w) for w in raw]
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((t for c in cut for t in c), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[first] = self.width  # the first token is checked by itself
        keys, at = np.unique(before * self.width + flat, return_inverse=True)
        ok = np.empty(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            v = self.verdict.get(k)
            if v is None:
                v = self.verdict[k] = self.stands(k)
            ok[i] = v
        good = np.logical_and.reduceat(ok[at], first)
        ids = flat.astype("<u4").tobytes()
        for w, r, g, s, n in zip(words, raw, good.tolist(), first.tolist(), size.tolist()):
            self.known.now[w] = ids[4 * s : 4 * (s + n)] if g else np.array(self.exact(r), "<u4").tobytes()
        if len(self.verdict) > 400_000:
            self.verdict.clear()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str | int]] = []
        for text in texts:
            if self.split_special and "<|" in text:
                got: list = []
                for piece in self.split_special(text):
                    got += [self.special[piece]] if piece in self.special else self.words(piece)
                parts.append(got)
            else:
                parts.append(self.words(text))
        self.known.turn()
        new = self.known.missing(set().union(*parts))
        self.known.now |= {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        if new := [w for w in new if isinstance(w, str)]:
            self.learn(new)
        return list(map(self.known.joined, parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> SpeculativeBPE:
    """One per worker process."""
    return SpeculativeBPE(path)


#: Characters of text that are encoded at once.
CHUNK_CHARS = 2_000_000


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Whole texts in groups of bounded size; null is empty."""
    now, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        now.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text that they decode to.

    A row for each row, whatever its id; a null or empty text has no ids. Special tokens in a text are matched as such.
    vocabulary: path of the JSON file, the same on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                ids = bpe.encode_batch(texts)
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of stored ids; null ids are the empty text, invalid bytes become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    e = encode(docs, vocabulary)
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
