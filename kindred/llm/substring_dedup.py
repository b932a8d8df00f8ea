"""Removal of word passages that occur more than once, by level-wise doubling of window lengths.

The first level looks at short windows, and only at anchors: of the short windows inside any full window, the one of
least hash. Two equal full windows choose equal anchors, so a full window can repeat only if its anchor does. Where
anchors repeat, each of their full windows extends its own to twice the length, to the right where it has the room and
else to the left, and so on until no candidates survive or the wanted length is reached; what repeats there is removed.
Texts equal as wholes are looked at once. Up to the last level a 64-bit hash stands for a window, which lets others
through at worst; windows of the last level have two of them, of different seeds from the bytes on, and texts a key of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import flagged, left_join_few, made, quoted, shared_dir, stored, swept, text_key
from kindred.llm.words import Hasher, argmin, buffers, mix, parts, split

WINDOW = 35


#: The first level's windows have no more words.
SHORT = 12


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before; halves of an odd length overlap in a word."""
    out = [window]
    while out[0] > SHORT:
        out.insert(0, (out[0] + 1) // 2)
    return out


_FIRST, _SECOND = Hasher(0), Hasher(1)


class _Part:
    """Words of a few texts with their hashes."""

    def __init__(self, text: pa.Array) -> None:
        self.data, off = buffers(text)
        self.start, self.end, self.first = split(self.data, off)
        self.hash = _FIRST.words(self.data, self.start, self.end)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.left = np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))  # words up to the text's end

    def windows(self, width: int) -> np.ndarray:
        return _FIRST.windows(self.hash, width)

    def second(self, width: int) -> np.ndarray:
        """Another hash of each window, from the bytes on."""
        return _SECOND.windows(_SECOND.words(self.data, self.start, self.end), width)

    def fits(self, width: int) -> np.ndarray:
        """Whether a window of the text begins at each word (of those where a window of the whole part does)."""
        return self.left[: max(0, len(self.hash) - width + 1)] >= width

    def places(self, steps: list[int], window: int) -> np.ndarray:
        """Per full window of the part, where its window of steps[-1] words begins: the anchor, extended step by step."""
        n = len(self.hash) - window + 1
        if n <= 0:
            return np.empty(0, np.int64)
        begin, at = np.arange(n), argmin(self.windows(steps[0]), window - steps[0] + 1)
        for width, wider in zip(steps, steps[1:]):
            at = np.where(at + wider <= begin + window, at, at + width - wider) if wider < window else begin
        return at


def _distinct(*h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row, how often the row comes)."""
    order = np.lexsort(h)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in h:
        new[1:] |= x[order][1:] != x[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _repeated(rows: DataFrame, *h: str) -> DataFrame:
    """(h): windows of two texts, or twice in one. Counts combine before the shuffle, so a hot window is one row a task."""
    g = rows.groupBy(*h).agg(F.min("short").alias("a"), F.max("short").alias("b"), F.max("n").alias("n"))
    return g.where("a <> b OR n > 1").select(*h)


def _found(rows: DataFrame, *h: str) -> DataFrame:
    return rows.join(_repeated(rows, *h), list(h)).groupBy("short").agg(F.collect_set("h").alias("found"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, whole, found): per distinct text with repeated windows their hashes, or whole if the text itself comes twice.

    docs has key, the 16 bytes that stand for a text, short, a 64-bit hash of them, and text. Texts whose short keys
    clash would share what was found, which is right for both, for what was found does repeat; that two which share a
    window with each other and nobody else clash is taken as impossible.
    """
    home = shared_dir(docs.sparkSession, "substrings")
    steps = levels(window)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            p, short = _Part(b.column(1)), b.column(0).to_numpy()
            one = np.zeros(len(short), bool)
            one[np.unique(short, return_index=True)[1]] = True  # copies in the part are looked at once
            at = p.places(steps[:1], window)
            at = np.unique(at[p.fits(window) & one[p.text[: len(at)]]])
            g, of = p.windows(steps[0])[at] if len(at) else np.empty(0, np.uint64), p.text[at]
            i, n = _distinct(g, of)
            yield pa.RecordBatch.from_arrays([pa.array(short[of[i]]), _signed(g[i]), pa.array(np.minimum(n, 2), pa.int8())], ["short", "h", "n"])

    rows = docs.select("short", "text").mapInArrow(first, "short bigint, h bigint, n tinyint")
    found = stored(_found(rows, "h"), f"{home}/{steps[0]}")
    # the last level is confirmed by two hashes, also where it is the first
    for k in range(1, max(2, len(steps))):
        found = stored(_extend(docs, found, steps[:k], (steps + [window])[k], window), f"{home}/{k}")
    texts = docs.groupBy("key").agg(F.min("short").alias("short"), (F.count(F.lit(1)) > 1).alias("whole"))
    both = texts.join(found, "short", "left").where("whole OR found IS NOT NULL")
    return both.select("key", "whole", F.when(~F.col("whole"), F.col("found")).alias("found"))


def _extend(docs: DataFrame, found: DataFrame, steps: list[int], wider: int, window: int) -> DataFrame:
    """(short, found) for windows of `wider` words that extend a found one of steps[-1], if they repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            p, short = _Part(b.column(1)), b.column(0).to_numpy()
            was, now = p.places(steps, window), p.places([*steps, wider], window)
            alive = np.append(_marks(p, b.column(2), steps[-1]), False)
            at = np.unique(now[p.fits(window) & alive[np.minimum(was, len(alive) - 1)]]) if len(now) else now
            g, of = p.windows(wider)[at] if len(at) else np.empty(0, np.uint64), p.text[at]
            g2 = p.second(wider)[at] if wider == window and len(at) else np.zeros(len(at), np.uint64)
            i, n = _distinct(g, g2, of)
            yield pa.RecordBatch.from_arrays([pa.array(short[of[i]]), _signed(g[i]), _signed(g2[i]), pa.array(np.minimum(n, 2), pa.int8())], ["short", "h", "h2", "n"])

    few = flagged(docs, found, "short").where("_flag").select("key", "short", "text")
    one = few.dropDuplicates(["key"]).join(found, "short")
    rows = one.select("short", "text", "found").mapInArrow(run, "short bigint, h bigint, h2 bigint, n tinyint")
    return _found(rows, "h", "h2")


def _marks(p: _Part, found: pa.Array, width: int) -> np.ndarray:
    """Whether one of its text's found windows begins at each word."""
    n = len(p.hash) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    size = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    v = found.flatten()
    values = v.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    salt = _salt(len(size))
    mine = p.windows(width) ^ salt[p.text[:n]]
    return np.isin(mine, values ^ np.repeat(salt, size)) & p.fits(width)


def _salt(n: int) -> np.ndarray:
    """A random value per text, so that one sorted search looks each text up in its own windows."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def substring_dedup(docs: DataFrame, window: int = WINDOW, text_col: str = "text", kept_col: str = "kept_text") -> DataFrame:
    """docs with kept_col, n_words and n_removed: words covered by a repeated window go, the others are joined by a blank.

    Words are runs of bytes outside 20 and 09 to 0D (hexadecimal). A window repeats if its word sequence starts
    anywhere else, in the same text too. Null and empty texts have no words; texts shorter than the window lose none;
    rows repeated with one text lose it wholly if it is long enough; an empty table gives no rows. All columns are
    kept, except that columns of the three names made here are replaced.
    """
    own = [f"row.{quoted(c)}" for c in docs.columns if c not in (kept_col, "n_words", "n_removed")]
    return cut_rows(docs, window, text_col).select(*own, F.col("kept").alias(kept_col), "n_words", "n_removed")


def cut_rows(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """(row, kept, n_words, n_removed): row holds all columns of docs, whatever their names."""
    before = len(made)
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = held.withColumn("key", text_key("text")).withColumn("short", F.xxhash64("key"))
    seen = repeats(held.select("key", "short", "text"), window)
    joined = left_join_few(held, seen, "key")

    @F.arrow_udf("struct<kept: string, n_words: bigint, n_removed: bigint>")
    def cut(text: pa.Array, whole: pa.Array, found: pa.Array) -> pa.Array:
        kept: list[str] = []
        n, gone = [], []
        for b in parts(iter([pa.RecordBatch.from_arrays([text, whole.fill_null(False), found], ["t", "w", "f"])]), 0):
            p = _Part(b.column(0))
            hit = _marks(p, b.column(2), window)
            cover = np.zeros(len(p.hash) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(hit), 1)
            np.add.at(cover, np.flatnonzero(hit) + window, -1)
            out = np.cumsum(cover)[:-1] > 0
            out |= np.repeat(b.column(1).to_numpy(zero_copy_only=False) & (p.count >= window), p.count)
            raw = p.data.tobytes()
            lost = np.bincount(p.text[out], minlength=len(p.count))
            n += p.count.tolist()
            gone += lost.tolist()
            for i, (u, v) in enumerate(zip(p.first, p.first[1:])):
                if lost[i] == v - u:
                    kept.append("")
                elif not lost[i]:
                    kept.append(b" ".join(raw[p.start[u] : p.end[v - 1]].split()).decode())
                else:
                    kept.append(b" ".join(raw[s:e] for s, e, o in zip(p.start[u:v], p.end[u:v], out[u:v]) if not o).decode())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["kept", "n_words", "n_removed"])

    return swept(joined.select("row", cut("text", "whole", "found").alias("c")).select("row", "c.*"), before)
