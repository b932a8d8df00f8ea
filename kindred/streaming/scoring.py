"""Scoring of a stream of pool rows against a fixed seed set, and the k best of all that have arrived.

Both run the batch search on each micro-batch, so a row comes out once, however many blocks its bucket's seeds fill. What a
micro-batch leaves has its number and is overwritten when the batch is repeated, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.ranking import topk
from kindred.operators.similarity import lsh_max_sim_arrow


def _run(pool: DataFrame, home: str, batch) -> StreamingQuery:
    return pool.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()


def score_stream(pool: DataFrame, seeds: DataFrame, home: str) -> StreamingQuery:
    """Writes (id, sim) of every arriving row (id, bucket, v, norm) that meets a seed of its bucket to home/scores, a row for an id and batch."""

    def score(rows: DataFrame, n: int) -> None:
        lsh_max_sim_arrow(rows, seeds, keep_unmatched=False).write.mode("overwrite").parquet(f"{home}/scores/batch={n}")

    return _run(pool, home, score)


def _batches(spark: SparkSession, home: str) -> list[int]:
    """The micro-batches that have left a finished table of the best."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/best")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if done(s.getPath()))


def best_so_far(spark: SparkSession, home: str) -> DataFrame:
    """(id, sim): the k best rows of all micro-batches until now."""
    done = _batches(spark, home)
    schema = "id bigint, sim double"
    return spark.read.schema(schema).parquet(f"{home}/best/{done[-1]}") if done else spark.createDataFrame([], schema)


def topk_stream(pool: DataFrame, seeds: DataFrame, k: int, home: str) -> StreamingQuery:
    """Keeps the k best of all arriving rows in home/best, an id once with its greatest similarity; see best_so_far().

    The state is a table of k rows for the last two micro-batches: a repeated batch starts from the one before it.
    """

    def merge(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        before = [i for i in _batches(spark, home) if i < n]
        scored = lsh_max_sim_arrow(rows, seeds, keep_unmatched=False)
        if before:
            scored = scored.unionByName(spark.read.schema("id bigint, sim double").parquet(f"{home}/best/{before[-1]}"))
        best = topk(scored.groupBy("id").agg(F.max("sim").alias("sim")), k)
        best.write.mode("overwrite").parquet(f"{home}/best/{n}")
        for old in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/best/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return _run(pool, home, merge)
