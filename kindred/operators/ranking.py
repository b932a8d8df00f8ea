"""Deterministic best-k, overall and per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk(scored: DataFrame, k: int) -> DataFrame:
    """The k best (id, sim), ties to the lower id; similarities rank after rounding to 9 digits."""
    return scored.orderBy(F.desc(F.round("sim", 9)), "id").limit(k)


def perquery_topk(dist: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, dist): the k smallest distances of each query; a group limit runs before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.round("dist", 9), "id")
    return dist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def perquery_kth(dist: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th smallest distance, or the largest of fewer."""
    return perquery_topk(dist, k).groupBy("query_id").agg(F.max("dist").alias("kth"))
