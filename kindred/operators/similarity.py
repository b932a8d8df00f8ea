"""Exact, bucketed and bounded searches for the pool rows nearest to any seed.

Every search takes (id, v, norm) relations. There are two kernels with the same answer: matrix products over a grid of
tiles (arrow), and SQL, where seeds reach the pool in blocks nested in arrays, so that a pool row meets a few wide rows
instead of one row per pair, and the maximum is folded inside the expression.
With `others` both sides come from one table, and no row is compared with itself (the same id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kindred.functions import vector as V
from kindred.operators.bounded import bound_topk  # noqa: F401  the bounded search belongs to these
from kindred.operators.ranking import topk
from kindred.operators.summary import bucket_summary
from kindred.operators.tiles import SCORES, Grid, best_cosine, best_of, every_pair
from kindred.sources.work import Work

#: Seeds nested in one array.
BLOCK = 256


def cosine_pairs(pool: DataFrame, seeds: DataFrame, others: bool = False, digits: int | None = None) -> DataFrame:
    """(id, seed_id, sim) of every pair, for a stated seed set, to `digits` digits; null similarity for a zero norm."""
    return every_pair(pool, seeds, True, others, digits).withColumnRenamed("x", "sim")


def cosine_stats(pool: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, pairs, best) of every pool row, if there are seeds: how many of cosine_pairs have a similarity, and the greatest."""
    one = lambda df: df.withColumn("bucket", F.lit(0))
    met = Grid(one(pool), one(seeds)).run(best_cosine(floor=float("-inf")), SCORES)
    some = seeds.select(F.lit(0).cast("bigint").alias("met")).limit(1)
    none = pool.select("id", F.lit(None).cast("double").alias("sim")).crossJoin(F.broadcast(some))
    return met.unionByName(none).groupBy("id").agg(F.sum("met").alias("pairs"), F.max("sim").alias("best"))


def _blocks(seeds: DataFrame, *keys: str, ids: bool = False) -> DataFrame:
    """Seeds nested in blocks of about BLOCK, as (id, v) if ids are asked for; a hot bucket becomes many blocks, never one row."""
    number = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)))
    live = seeds.where("norm > 0").select(*keys, "id", "v", "norm")
    n = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    live = live.join(n, list(keys)) if keys else live.crossJoin(F.broadcast(n))
    unit = F.transform("v", lambda x: x / F.col("norm"))
    seed = F.struct("id", unit.alias("v")) if ids else unit
    return live.groupBy(*keys, number.alias("_block")).agg(F.collect_list(seed).alias("_seeds"))


def _fold(joined: DataFrame, others: bool = False) -> DataFrame:
    """(id, sim): the greatest cosine over the nested seeds, 0 at least."""
    if others:
        seeds = F.transform(F.filter("_seeds", lambda s: s["id"] != F.col("id")), lambda s: s["v"])
        joined = joined.withColumn("_seeds", seeds).where("_seeds IS NULL OR size(_seeds) > 0 OR _keep")
    best = F.aggregate(F.col("_seeds"), F.lit(0.0), lambda m, s: F.greatest(m, V.dot("v", s)))
    sim = F.when(F.col("norm") > 0, F.try_divide(best, F.col("norm"))).otherwise(F.lit(0.0))
    return joined.select("id", F.coalesce(sim, F.lit(0.0)).alias("_s")).groupBy("id").agg(F.max("_s").alias("sim"))


def brute_max_sim(pool: DataFrame, seeds: DataFrame, others: bool = False) -> DataFrame:
    """Best cosine to any seed, floored at 0; zero-norm pool rows are left out.

    Each pool row meets each block of the seeds, a stated query set; the block side is broadcast only
    when Spark's own statistics put it under the threshold, otherwise it is a blocked product.
    """
    return _fold(pool.where("norm > 0").crossJoin(_blocks(seeds, ids=others)).withColumn("_keep", F.lit(False)), others)


def brute_max_sim_arrow(pool: DataFrame, seeds: DataFrame, others: bool = False, observation: Observation | None = None) -> DataFrame:
    """As brute_max_sim, by matrix products over a grid of tiles."""
    one = lambda df: df.withColumn("bucket", F.lit(0))
    return lsh_max_sim_arrow(one(pool), one(seeds), False, others, observation)


def brute_topk(pool: DataFrame, seeds: DataFrame, k: int, others: bool = False, kernel: str = "arrow", observation: Observation | None = None) -> DataFrame:
    return topk(brute_max_sim_arrow(pool, seeds, others, observation) if kernel == "arrow" else brute_max_sim(pool, seeds, others), k)


def lsh_max_sim(pool: DataFrame, seeds: DataFrame, keep_unmatched: bool = True, others: bool = False) -> DataFrame:
    """Best cosine to a seed of the same bucket; both sides carry `bucket`.

    keep_unmatched: pool rows without such a seed, or of zero norm, come out at 0; otherwise they go.
    """
    left = pool if keep_unmatched else pool.where("norm > 0")
    met = left.join(_blocks(seeds, "bucket", ids=others), "bucket", "left" if keep_unmatched else "inner")
    return _fold(met.withColumn("_keep", F.lit(keep_unmatched)), others)


def lsh_topk(pool: DataFrame, seeds: DataFrame, k: int, keep_unmatched: bool = True, others: bool = False, kernel: str = "arrow", observation: Observation | None = None) -> DataFrame:
    return topk(lsh_max_sim_arrow(pool, seeds, keep_unmatched, others, observation) if kernel == "arrow" else lsh_max_sim(pool, seeds, keep_unmatched, others), k)


def lsh_max_sim_arrow(pool: DataFrame, seeds: DataFrame, keep_unmatched: bool = True, others: bool = False, observation: Observation | None = None) -> DataFrame:
    """As lsh_max_sim, by matrix products over a grid of tiles: a hot bucket is cut on both sides, and no side is shipped whole.

    observation gets `cosines`, how many the run computed.
    """
    best = best_of(Grid(pool, seeds).run(best_cosine(others), SCORES), observation)
    if keep_unmatched:
        best = best.unionByName(pool.select("id", F.lit(0.0).alias("sim"))).groupBy("id").agg(F.max("sim").alias("sim"))
    return best


def candidates(pool: DataFrame, summary: DataFrame, min_bound_seeds: int) -> DataFrame:
    """Pool rows of seeded buckets with their bound: (id, bucket, v, norm, n_seeds, theta, theta_b, ub, certain).

    The summary has a row per seeded bucket, 2^n_bits at most; Spark broadcasts it when it is small.
    Certain rows are scored in any case: few seeds, or the row lies inside the seeds' cone.
    """
    s = summary.select("bucket", "n_seeds", "centroid", "c_norm", "theta_b")
    cos = V.cosine("v", "centroid", "norm", "c_norm")
    out = pool.where("norm > 0").join(s, "bucket").withColumn("theta", V.angle(cos))
    ub = F.coalesce(V.upper_bound("theta", "theta_b"), F.lit(1.0))
    certain = (F.col("n_seeds") < min_bound_seeds) | F.coalesce(F.col("theta") <= F.col("theta_b"), F.lit(True))
    return out.withColumn("ub", ub).withColumn("certain", certain).drop("centroid", "c_norm")


def bound_prune_stats(pool: DataFrame, seeds: DataFrame, k: int, min_bound_seeds: int = 10, centroid: str = "mean") -> DataFrame:
    """(deferred, pruned, saved_pairs, small_pairs): bounded rows, those skipped, the comparisons that spared, and the
    comparisons made in buckets of too few seeds for a bound. These are of a threshold fixed after the certain rows; with
    fewer than k of those nothing is pruned."""
    with Work(pool.sparkSession, "prune") as work:
        cand = candidates(pool, bucket_summary(seeds, centroid), min_bound_seeds)
        cand = work.stored(cand.select("id", "bucket", "v", "norm", "n_seeds", "ub", "certain"), "candidates")
        first = topk(lsh_max_sim_arrow(cand.where("certain"), seeds, keep_unmatched=False), k).collect()  # k rows
        tau = first[-1]["sim"] if len(first) == k else 0.0
        judged = cand.withColumn("pruned", ~F.col("certain") & (F.greatest("ub", F.lit(0.0)) + 1e-7 < tau))
        seeds_of = lambda some: F.coalesce(F.sum(F.when(some, F.col("n_seeds"))), F.lit(0)).cast("bigint")
        out = judged.agg(
            F.count_if(~F.col("certain")).alias("deferred"), F.count_if("pruned").alias("pruned"),
            seeds_of(F.col("pruned")).alias("saved_pairs"), seeds_of(F.col("n_seeds") < min_bound_seeds).alias("small_pairs"),
        )
        return pool.sparkSession.createDataFrame(out.collect(), out.schema)
