"""Bucket centres of the seeds: mean or medoid, and the cone that holds the seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import vector as V
from kindred.operators.tiles import Grid, ids, unit
from kindred.sources.work import Work, ship


#: Buckets whose sums a task holds at once.
HELD = 1 << 14


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sum, cnt), sums of vectors with the number of vectors at each place, folded: one for each bucket if they are
    sorted by it, few otherwise."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        lists = (pa.array([x[i] for x in held.values()], pa.list_(kind)) for i, kind in ((0, pa.float64()), (1, pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *lists], ["bucket", "sum", "cnt"])

    for b in batches:
        bucket, size = b.column("bucket").to_numpy(zero_copy_only=False), b.column("sum").value_lengths().to_numpy(zero_copy_only=False)
        for w in np.unique(size).tolist():
            at = np.flatnonzero(size == w)
            order = at[np.argsort(bucket[at], kind="stable")]
            names, starts = np.unique(bucket[order], return_index=True)
            some = b.take(pa.array(order))
            sums = [np.add.reduceat(some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(order), w), starts, axis=0) for c in ("sum", "cnt")]
            for k, s, n in zip(names.tolist(), *sums):
                if k in held:
                    old, short = held[k], max(w, len(held[k][0]))
                    s, n = (np.pad(x, (0, short - w)) + np.pad(y, (0, short - len(y))) for x, y in zip((s, n), old))
                held[k] = (s, n)
        if len(held) > HELD:
            last = held.pop(bucket[-1])  # it may go on in the next batch
            yield out()
            held = {bucket[-1]: last}
    if held:
        yield out()


def bucket_centroid(seeds: DataFrame) -> DataFrame:
    """(bucket, n_seeds, centroid, c_norm): element-wise mean of all seeds of the bucket; null vectors don't count.

    Each task sums its vectors per bucket as arrays, so a bucket sends one row from each task, however hot it is.
    """
    ship(seeds.sparkSession)
    whole = seeds.where("norm IS NOT NULL AND size(v) > 0").select(F.col("bucket").cast("int").alias("bucket"), F.col("v").alias("sum"), F.transform("v", lambda x: F.lit(1).cast("bigint")).alias("cnt"))
    kind = "bucket int, sum array<double>, cnt array<bigint>"
    sums = whole.mapInArrow(_fold, kind).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_fold, kind)
    mean = F.zip_with("sum", "cnt", lambda s, n: s / n)
    return sums.select("bucket", F.array_max("cnt").alias("n_seeds"), mean.alias("centroid")).withColumn("c_norm", V.norm("centroid"))


#: Seeds of a bucket that the first round judges, and by how much each further round takes more.
FIRST, MORE = 16, 4
#: What a bound may pass the best by, in cosines, before it rules a seed out; above the rounding of the result.
MARGIN = 1e-7


def _judge(left: pa.Table, right: pa.Table) -> pa.Table:
    """(bucket, kind, id, cos, far): the least cosine of each row of the cell to those judged (kind 0), and of each judged one to the
    rows, with the row that has it (kind 1)."""
    cos = np.clip(unit(left) @ unit(right).T, -1, 1)
    i, j, worst = ids(left), ids(right), cos.argmin(0)
    n = len(i) + len(j)
    bucket = np.full(n, left["bucket"][0].as_py(), np.int32)
    kind = np.repeat(np.array([0, 1], np.int32), [len(i), len(j)])
    return pa.table({"bucket": bucket, "kind": kind, "id": np.concatenate([i, j]), "cos": np.concatenate([cos.min(1), cos.min(0)]), "far": np.concatenate([i, i[worst]])})


def bucket_medoid(seeds: DataFrame, counted: list[int] | None = None) -> DataFrame:
    """(bucket, seed_id, min_cos): the seed whose least cosine to its bucket, itself included, is greatest; ties to the lowest id.

    Found in rounds. A seed that has been judged, that is compared with its whole bucket, bounds the others: theirs is no
    greater than their cosine to it, and those whose bound is under the best so far are out. A round judges in each
    bucket the seeds of highest bound, some times more than the round before, and the farthest peers of those judged: by the
    triangle inequality, these bound a seed near a bad one at least as tightly as the bad one's distance less the way to it.
    Comparisons run on a grid of tiles, so a hot bucket is split; `counted` gets the cosines of each round. The table of
    results stays in the shared folder.
    """
    work, n, size = Work(seeds.sparkSession, "medoid"), 0, FIRST
    rows = work.stored(seeds.where("norm > 0").select(F.col("bucket").cast("int").alias("bucket"), "id", "v", "norm"), "rows")
    state = rows.select("bucket", "id", F.lit(1.0).alias("bound"))
    first = Window.partitionBy("bucket").orderBy(F.desc("bound"), F.xxhash64("id"), "id")
    some = lambda df, size: df.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= size).select("bucket", "id")
    batch, judged = some(state, size), None
    while True:
        grid = Grid(rows, rows.join(batch, ["bucket", "id"], "left_semi"))
        if counted is not None:
            counted.append(grid.cosines)
        met = work.stored(grid.run(_judge, "bucket int, kind int, id bigint, cos double, far bigint"), f"met-{n}")
        new = met.where("kind = 1").groupBy("bucket", "id").agg(F.min("cos").alias("c"), F.min_by("far", "cos").alias("far"))
        judged = work.stored(new if judged is None else judged.unionByName(new), f"judged-{n}")
        best = judged.groupBy("bucket").agg(F.max(F.struct(F.round("c", 9).alias("c"), (-F.col("id")).alias("m"))).alias("b"))
        bound = met.where("kind = 0").groupBy("bucket", "id").agg(F.min("cos").alias("c"))
        state = state.join(judged, ["bucket", "id"], "left_anti").join(bound, ["bucket", "id"]).join(best, "bucket")
        state = state.withColumn("bound", F.least("bound", "c")).where(F.col("bound") + MARGIN >= F.col("b.c")).select("bucket", "id", "bound")
        state = work.stored(state, f"state-{n}")
        work.drop(f"met-{n}")
        if n:
            work.drop(f"judged-{n - 1}")
            work.drop(f"state-{n - 1}")
        if state.isEmpty():
            break
        n, size = n + 1, size * MORE
        far = judged.select("bucket", F.col("far").alias("id")).join(state.select("bucket").distinct(), "bucket").distinct().join(judged, ["bucket", "id"], "left_anti")
        batch = some(state, size).union(far).distinct()
    for name in ("rows", f"state-{n}"):
        work.drop(name)
    return best.select("bucket", (-F.col("b.m")).alias("seed_id"), F.col("b.c").alias("min_cos"))


def bucket_summary(seeds: DataFrame, centroid: str = "mean") -> DataFrame:
    """(bucket, n_seeds, centroid, c_norm, theta_a, theta_b): the least and the widest angle from centre to seed."""
    centre = bucket_centroid(seeds)
    if centroid == "medoid":
        picked = bucket_medoid(seeds).select("bucket", F.col("seed_id").alias("id"))
        own = seeds.join(picked, ["bucket", "id"]).select("bucket", F.col("v").alias("centroid"), F.col("norm").alias("c_norm"))
        centre = centre.select("bucket", "n_seeds").join(own, "bucket")
    cos = V.cosine("v", "centroid", "norm", "c_norm")
    wide = seeds.join(centre.select("bucket", "centroid", "c_norm"), "bucket").groupBy("bucket").agg(F.min(V.angle(cos)).alias("theta_a"), F.max(V.angle(cos)).alias("theta_b"))
    return centre.join(wide, "bucket")
