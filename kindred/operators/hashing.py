"""Random-hyperplane buckets, their statistics, and the choice among sampled plane sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import vector as V


def planes_frame(spark: SparkSession, planes: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(planes)], "plane int, w array<double>")


def with_bucket(vectors: DataFrame, planes: Column | list[list[float]]) -> DataFrame:
    """Adds `bucket`; a narrow projection, so it needs no shuffle."""
    planes = V.planes_column(planes) if isinstance(planes, list) else planes
    return vectors.withColumn("bucket", V.signature("v", planes))


def bucket_members(bucketed: DataFrame) -> DataFrame:
    """(bucket, ids): the nested form, for reports; joins use the flat column."""
    return bucketed.groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def bucket_hist(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("cnt"))


def sampled_buckets(seeds: DataFrame, samples: list[list[list[float]]]) -> DataFrame:
    """(sample, bucket, cnt) of each sampled plane set; one pass over the seeds.

    The sample table has as many rows as there are samples, a parameter, so its broadcast is bounded.
    """
    spark = seeds.sparkSession
    table = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "sample int, planes array<array<double>>")
    at = seeds.select("v").crossJoin(F.broadcast(table)).select("sample", V.signature("v", F.col("planes")).alias("bucket"))
    return at.groupBy("sample", "bucket").agg(F.count(F.lit(1)).alias("cnt"))


def signature_cost(seeds: DataFrame, samples: list[list[list[float]]]) -> DataFrame:
    """(sample, cost): sum of squared bucket sizes."""
    return sampled_buckets(seeds, samples).groupBy("sample").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("cost"))


def best_signature(seeds: DataFrame, samples: list[list[list[float]]]) -> DataFrame:
    """One row: the first sample of least cost."""
    least = F.min(F.struct("cost", "sample")).alias("m")
    return signature_cost(seeds, samples).agg(least).select(F.col("m.sample").alias("sample"), F.col("m.cost").alias("cost"))


def best_planes(seeds: DataFrame, samples: list[list[list[float]]]) -> list[list[float]]:
    """The chosen planes; brings a single row to the driver."""
    row = best_signature(seeds, samples).first()
    return samples[row["sample"] if row and row["sample"] is not None else 0]


def in_near_buckets(seeds: DataFrame, bits: int, flips: int) -> DataFrame:
    """Each seed once for every bucket that differs from its own in `flips` planes at most."""
    masks = [m for m in range(1 << bits) if m.bit_count() <= flips]
    mask = F.explode(F.array(*[F.lit(m) for m in masks]))
    return seeds.withColumn("_mask", mask).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("_mask"))).drop("_mask")
