"""Importance resampling of documents towards a target distribution, in two passes over Arrow batches.

Features are hashed word n-grams. The first pass counts the buckets of each partition with np.bincount; treeReduce merges
these vectors, whose length is fixed. Their ratio to the target's counts gives each bucket a gain. The second pass
gathers the broadcast gains and sums them per document. A Gumbel variate drawn from the id is added, so that the highest
scores are a sample without replacement; the rank comes from a range sort, never from one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import shared_dir, stored
from kindred.llm.words import LOWER, SIGNS, buffers, parts, split

#: Levels of the tree that merges the partitions' vectors: of p partitions, about the cube root meets in a task or the driver.
DEPTH = 3
#: Words of more bytes are checksummed one by one.
LONG = 48
#: Bits of monotonically_increasing_id that number a partition's rows.
ROW_BITS = 33


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _crc_table()


def crc(value: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of bytes whose checksum is `value`, followed by a run of the buffer; one for each run."""
    out, size = ~value, end - start
    at, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(at):
        out[at] = _TABLE[(out[at] ^ data[start[at] + k]) & 255] ^ (out[at] >> 8)
        k += 1
        at = at[size[at] > k]
    out = ~out
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(value[i]))
    return out


def hashed(text: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, words): bucket and text number of every run of 1 to n words, and the words of each text."""
    data, offsets = buffers(text)
    data = LOWER[data]
    start, end, first = split(data, offsets, SIGNS)
    own = np.repeat(np.arange(len(text)), np.diff(first))
    last = first[1:][own]  # of each word, where its text's words end
    value = crc(np.zeros(len(start), np.uint32), data, start, end)
    found, texts, at = [value], [own], np.arange(len(start))
    blank, zero = np.array([32], np.uint8), np.zeros(1, np.int64)
    for k in range(1, n):
        value, at = value[at + k < last[at]], at[at + k < last[at]]
        value = crc(value, blank, np.repeat(zero, len(at)), np.repeat(zero + 1, len(at)))
        value = crc(value, data, start[at + k], end[at + k])
        found.append(value)
        texts.append(own[at])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(texts), np.diff(first)


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in parts(batches, 0):
            total += np.bincount(hashed(b.column(0), n, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, DEPTH)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of target to raw frequency of each bucket, one added to every count; rounded down."""
    s, t, width = float(raw.sum()), float(target.sum()), float(len(raw))
    ratio = lambda a, b: ((b + 1.0) * (s + width)) / ((a + 1.0) * (t + width))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(id_col: str | Column, seed: int) -> Column:
    """A thousand times the Gumbel variate of an id under a seed, rounded down; a null id counts as the empty text."""
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, percent: int, home: str) -> DataFrame:
    """rows (score, doc_id, _row and others, stored) with `rank` of the highest scores, ties to the smaller id, percent of all; null beyond.

    A range sort is written; the counts of its partitions, one number each, say at which rank a partition begins.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    at = F.monotonically_increasing_id()
    spread = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), home)
    part = F.shiftright("_at", ROW_BITS)
    counts = sorted(tuple(r) for r in spread.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins = np.cumsum([0] + [n for _, n in counts])
    table = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, begins)], "_part bigint, _begin bigint")
    drawn = int(begins[-1]) * percent // 100
    rank = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    met = spread.join(F.broadcast(table), part == F.col("_part"))  # a row per partition
    return met.select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (of those drawn; null for the others).

    Words are runs of bytes other than ASCII signs, blanks and controls, A-Z lower-cased; a feature is a run of 1 to n words
    of a text, repeats counted, in the bucket that its CRC-32 gives. A null text has no words, and weight 0. Of the rows
    with least_words or more, percent of a hundred are drawn, rounded down. Repeated rows have the same score and are drawn
    each on its own, next to each other; a null id comes after the others. An empty table gives no rows, an empty
    target makes rare features heavy; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, text_col, n, buckets))
    shipped = spark.sparkContext.broadcast(gain.astype(np.float64))  # as long as there are buckets

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shipped.value
        for b in parts(batches, 1):
            bucket, own, words = hashed(b.column(1), n, buckets)
            size, weight = np.bincount(own, minlength=b.num_rows), np.bincount(own, g[bucket], b.num_rows)  # whole numbers under 2^53
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (words, size, weight))], ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = slim.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    rows = rows.withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("_row", F.monotonically_increasing_id())
    home = shared_dir(spark, "resampling")
    rows = stored(rows, f"{home}/rows")
    long = F.col("n_words") >= least_words
    out = ranked(rows.where(long), percent, f"{home}/sorted").unionByName(rows.where(~long).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
