"""Packing of documents into sequences by best-fit decreasing.

Placing a document depends only on its length and on how many bins have each remaining capacity. So the driver runs
best-fit decreasing over the histogram of lengths: a segment tree over the capacities finds the tightest open bin, and
all bins of one capacity and all pieces of one length move together. That plan is bounded by the capacity, not by the
corpus; the pieces then take their places from their rank within their length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import Recent, shared_dir, stored

CAPACITY = 4096
END_ID = 1
#: Chunks of text whose ids a worker keeps before it starts afresh.
CACHE_CHUNKS = 200_000
#: A single comma or stop after a letter or digit (ASCII, or of two bytes from C3).
_STOP = re.compile(rb"(?s).*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[,.]").fullmatch
#: A special token of the vocabulary, which cuts a text wherever it stands.
PART = "<|endoftext|>"
#: Parts that share out the ranks of each length at least, and pieces of a length for which there is one more.
SALTS, RUN = 64, 1_000_000


class WordEncoder:
    """Ids of a text under a tokenizer file whose splits never cross white space: chunk by chunk, each seen once."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.part = self.tokenizer.token_to_id(PART)
        self.known = Recent(CACHE_CHUNKS)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # cut at ASCII white space only; capitals fold early unless a special token or a combining mark may hang on them
        parts = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        self.known.turn()
        new = self.known.missing(set().union(*parts))
        if ended := [w for w in new if _STOP(w)]:  # the mark is a piece of its own, so what stands before it is looked up
            self._learn(list(set(new).difference(ended)))
            self._learn(self.known.missing({w[:-1] for w in ended} | {b",", b"."}))
            self.known.now.update((w, self.known.now[w[:-1]] + self.known.now[w[-1:]]) for w in ended)
        else:
            self._learn(new)
        return list(map(self.known.joined, parts))

    def _learn(self, chunks: list[bytes]) -> None:
        """Encodes many chunks in one text, parted by a special token that none of them holds."""
        odd = [c for c in chunks if b"<|" in c]
        for c in odd:
            self.known.now[c] = array("I", self.tokenizer.encode(c.decode(), add_special_tokens=False).ids).tobytes()
        chunks = [c for c in chunks if b"<|" not in c] if odd else chunks
        runs = [chunks[i : i + 500] for i in range(0, len(chunks), 500)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([PART.join(map(bytes.decode, r)) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == self.part) * 4
            raw, ends = ids.tobytes(), [*at.tolist(), 4 * len(ids)]
            self.known.now.update(zip(run, (raw[x:y] for x, y in zip([0, *(at + 4).tolist()], ends))))


@lru_cache(maxsize=4)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and the end id, cut only where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            doc, text = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            at = 0
            while at < len(doc):
                some, size = [], 0
                while at + len(some) < len(doc) and size < 2_000_000:
                    some.append(text[at + len(some)].as_py() or b"")
                    size += len(some[-1])
                rows: list[tuple] = []
                for d, ids in zip(doc[at:], enc.encode_batch(some)):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[s : s + 4 * capacity]
                        rows.append((d, k, s // 4, len(cut) // 4, cut))
                at += len(some)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class TightestFit:
    """A segment tree over capacities 0..n: how many open bins have each, and the least that fits."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += count
            i >>= 1

    def least(self, need: int) -> int | None:
        """The smallest capacity of an open bin that is at least need."""
        i = need + self.leaves
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over lengths: rows (length, first_rank, count, per_bin, first_bin, offset).

    The piece of rank first_rank + j goes to bin first_bin + j // per_bin at offset + j % per_bin * length.
    """
    tree, open_bins, bins, rows = TightestFit(capacity), {}, 0, []

    def reopen(left: int, first: int, n: int) -> None:
        if n and left:
            open_bins.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            room = tree.least(length)
            if room is None:  # new bins, as many as the rest can fill
                room, per = capacity, capacity // length
                first, n = bins, -(-todo // per)
                bins += n
            else:
                (first, n), per = open_bins[room].pop(), room // length
                tree.add(room, -n)
            used = min(n, -(-todo // per))
            reopen(room, first + used, n - used)
            full, over = divmod(min(todo, used * per), per)
            rows.append((length, rank, full * per + over, per, first, capacity - room))
            reopen(room - per * length, first, full)
            if over:
                reopen(room - over * length, first + full, 1)
            rank += full * per + over
            todo -= full * per + over
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (a row per piece with doc_id, piece, length) with sequence_id and offset added.

    Pieces of one length are interchangeable: their rank comes from a hash-salted order, so a hot length is shared out over
    as many parts as it has RUN pieces, and SALTS at least. The histogram of lengths, at most `capacity` rows, and the plan go
    to the driver; the parts' first ranks stay with the executors. Columns of cut other than these three are kept.
    """
    spark, names = cut.sparkSession, cut.columns
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows: dict[int, list] = {}
    for r in plan(histogram, capacity):
        rows.setdefault(r[0], []).append(r[1:])
    shipped = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in rows.items()})
    parts = spark.createDataFrame([(k, SALTS + n // RUN) for k, n in histogram.items()], "length bigint, _parts bigint")
    salted = cut.join(F.broadcast(parts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_nth", nth).join(base, ["length", "_salt"]).select(*names, (F.col("_base") + F.col("_nth") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shipped.value
        for b in batches:
            length, ranks = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                k = int(length[at[0]])
                rank, plan_of = ranks[at], rows[k]
                r = plan_of[np.searchsorted(plan_of[:, 0], rank, "right") - 1]
                j = rank - r[:, 0]
                seq[at], off[at] = r[:, 3] + j // r[:, 2], r[:, 4] + j % r[:, 2] * k
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and give the end id alone; rows repeated with one id are packed each; other columns are
    ignored, whatever their names; an empty table gives no rows. The slim table of pieces is stored, so texts are encoded once.
    """
    cut = pieces(docs, vocabulary, capacity, id_col, text_col)
    slim = stored(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), shared_dir(docs.sparkSession, "pieces"))
    return pack(slim, capacity)
