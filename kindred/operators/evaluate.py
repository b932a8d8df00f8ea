"""Reports: overlap of two answers and the work that a plane set implies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.hashing import sampled_buckets


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(matched, total, recall) over distinct ids; recall is null for an empty truth."""
    hit = found.select("id").distinct().withColumn("_hit", F.lit(1))
    at = truth.select("id").distinct().join(hit, "id", "left")
    out = at.agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("recall", F.try_divide(F.col("matched").cast("double"), F.col("total").cast("double")))


def lsh_cost(pool: DataFrame, seeds: DataFrame) -> DataFrame:
    """(pairs): cosines that the bucketed search evaluates."""
    a = pool.groupBy("bucket").agg(F.count(F.lit(1)).alias("a"))
    b = seeds.groupBy("bucket").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "bucket").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("bigint").alias("pairs"))


def lsh_cost_study(pool: DataFrame, seeds: DataFrame, samples: list[list[list[float]]]) -> DataFrame:
    """(min_pairs, max_pairs, avg_pairs) of that work over sampled plane sets."""
    a = sampled_buckets(pool, samples).withColumnRenamed("cnt", "a")
    b = sampled_buckets(seeds, samples).withColumnRenamed("cnt", "b")
    per = a.join(b, ["sample", "bucket"], "left").groupBy("sample").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("bigint").alias("c"))
    return per.agg(F.min("c").alias("min_pairs"), F.max("c").alias("max_pairs"), F.avg("c").alias("avg_pairs"))
