"""An index of several hash tables over the pool, probed by the queries where neighbours are likeliest.

Each table has its own planes. A pool row goes to one bucket of every table; a query looks into its own bucket and those
whose planes it lies nearest to: a probe's cost is the sum of squared distances to the planes it crosses, and the
cheapest are taken. Rows met in any table are candidates, and only they are compared, by matrix tiles. Tables and planes
are settings: more planes for larger pools keep the share of candidates small, more tables keep the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kindred.operators.ranking import topk
from kindred.operators.tiles import SCORES, Grid, Kernel, best_of, ids, unit
from kindred.sources.work import Work, ship

#: Planes of one table at most: a probe looks through all sets of planes to cross.
MAX_BITS = 16
#: Cells of the table of costs that are sorted at once.
CHUNK = 1 << 20
#: Pool rows and seeds of a cell: so many times so many candidates are listed there at most.
POOL_TILE, SEED_TILE = 1 << 12, 1 << 11
#: Candidates that are compared at once.
LISTED = 1 << 19


class Tables:
    """Planes of every table, as rows; bits planes each."""

    def __init__(self, planes: list[list[list[float]]]) -> None:
        self.w = np.array(planes, float)
        if self.w.ndim != 3 or not 1 <= self.w.shape[1] <= MAX_BITS:
            raise ValueError(f"tables of 1 to {MAX_BITS} planes each, all of one length")
        self.bits = self.w.shape[1]

    def _sides(self, v: np.ndarray) -> np.ndarray:
        """Distances to the planes: (rows, tables, planes)."""
        return np.einsum("nd,tbd->ntb", v, self.w, optimize=True)

    def _number(self, bucket: np.ndarray) -> np.ndarray:
        """One key for a bucket of a table."""
        return bucket + (np.arange(bucket.shape[1], dtype=np.int64) << self.bits)[None, :, None]

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """The keys of each row's own buckets, (rows, tables); the first plane is the most significant bit."""
        own = (self._sides(v) >= 0) @ (1 << np.arange(self.bits)[::-1])
        return self._number(own[:, :, None])[:, :, 0]

    def probes(self, v: np.ndarray, number: int) -> np.ndarray:
        """The keys of the buckets that each row looks into, (rows, tables, number), the likeliest first."""
        d = self._sides(v)
        own = (d >= 0) @ (1 << np.arange(self.bits)[::-1])
        mask = np.arange(1 << self.bits)
        crossed = ((mask[:, None] >> np.arange(self.bits)[::-1]) & 1).astype(float)
        out, step = np.empty((*own.shape, min(number, len(mask))), np.int64), max(1, CHUNK // (len(mask) * own.shape[1]))
        for lo in range(0, len(v), step):
            cost = d[lo : lo + step] ** 2 @ crossed.T
            out[lo : lo + step] = own[lo : lo + step, :, None] ^ np.argsort(cost, axis=2, kind="stable")[:, :, :number]
        return self._number(out)


def _keys(df: DataFrame, tables: Tables, probes: int | None) -> DataFrame:
    """(id, key): the buckets of each row, or those that it probes."""
    shipped = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for b in batches:
            for some in (b.slice(lo, 512) for lo in range(0, b.num_rows, 512)):
                v = unit(pa.Table.from_batches([some]))
                key = t.buckets(v) if probes is None else t.probes(v, probes).reshape(len(v), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column("id").to_numpy(), key.shape[1])), pa.array(key.ravel())], ["id", "key"])

    return df.select("id", "v", "norm").mapInArrow(run, "id bigint, key bigint")


def _listed(others: bool) -> Kernel:
    """SCORES of pool rows that carry the ids of the seeds to compare with, `near`."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, i, j = unit(left), unit(right), ids(left), ids(right)
        order = np.argsort(j, kind="stable")
        near = left["near"].combine_chunks()
        size = near.value_lengths().to_numpy()
        off = np.append(0, np.cumsum(size))
        best, met = np.zeros(len(i)), np.zeros(len(i), np.int64)
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + LISTED, "right")) - 1)
            row, seed = np.repeat(np.arange(lo, hi), size[lo:hi]), near.slice(lo, hi - lo).flatten().to_numpy()
            at = order[np.minimum(np.searchsorted(j[order], seed), len(j) - 1)]
            good = (j[at] == seed) & ~(others & (i[row] == seed))  # a seed that isn't here has vectors of another length
            row, at = row[good], at[good]
            for x in range(0, len(row), 8192):
                r, c = row[x : x + 8192], at[x : x + 8192]
                np.maximum.at(best, r, np.einsum("nd,nd->n", a[r], b[c]))
            met += np.bincount(row, minlength=len(i))
            lo = hi
        return pa.table({"id": i[met > 0], "sim": best[met > 0], "met": met[met > 0]})

    return kernel


def index_topk(pool: DataFrame, seeds: DataFrame, k: int, planes: list[list[list[float]]], probes: int, others: bool = False, observation: Observation | None = None) -> DataFrame:
    """(id, sim) of the k pool rows whose best candidate seed is nearest; planes: a set for each table.

    Postings and probes meet as slim rows; a pool row's candidates are listed by blocks of seeds, so no list is longer than a
    block; all vectors have one length. observation gets `cosines`, how many were computed. Rows without a positive norm have no candidates. The
    table of candidates stays in the shared folder.
    """
    spark, tables = pool.sparkSession, Tables(planes)
    ship(spark)
    work = Work(spark, "index")
    pool, seeds = (x.where("norm > 0").select("id", "v", "norm") for x in (pool, seeds))
    blocks = -(-seeds.count() // SEED_TILE) or 1
    seeds = seeds.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = _keys(seeds, tables, probes).select(F.col("id").alias("seed"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("bucket"), "key")
    met = _keys(pool, tables, None).join(asked, "key")
    near = work.stored(met.groupBy("id", "bucket").agg(F.collect_set("seed").alias("near")), "near")
    size = {r["bucket"]: r["n"] for r in near.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
    held = seeds.groupBy("bucket", F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [(r["bucket"], r["w"], size[r["bucket"]], r["n"]) for r in held if r["bucket"] in size]
    grid = Grid(near.join(pool, "id"), seeds, POOL_TILE, 2 * SEED_TILE, counts=counts)  # a block is never cut, it is one bucket already
    return topk(best_of(grid.run(_listed(others), SCORES), observation), k)
