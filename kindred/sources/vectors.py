"""Delimited text and Parquet sources of vectors and planes, and sinks of planes and results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_vectors(lines: DataFrame, width: int, sep: str = ",") -> DataFrame:
    """`value` lines to ARRAY<DOUBLE> column `v`; a row of another width or with a bad cell raises.

    Blank cells and text that isn't a number are errors, never silent zeros.
    """
    cells = F.split(F.col("value"), re.escape(sep) if sep != " " else r"\s+")
    v = F.transform(cells, lambda x: x.try_cast("double"))
    bad = (F.size(v) != width) | F.exists(v, lambda x: x.isNull())
    checked = F.when(bad, F.raise_error(F.concat(F.lit(f"not a row of {width} numbers: "), F.substring("value", 1, 80))).cast("array<double>")).otherwise(v)
    return lines.withColumn("v", checked)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): the lines of text files numbered from 0, file after file by name, without gaps.

    Each byte range that a task reads is counted first; a line's number is the count of the ranges before its own and its
    place there. So the lines themselves are neither sorted nor shuffled, and no Python touches them. The table of
    ranges has three numbers for spark.sql.files.maxPartitionBytes of text, a five-millionth of it, and is broadcast.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).select("value", file.alias("_path"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_nth"))
    counts = lines.groupBy("_path", "_range").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_path", "_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = counts.select(F.xxhash64("_path").alias("_file"), "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_begin"))
    met = lines.withColumn("_file", F.xxhash64("_path")).join(F.broadcast(begins), ["_file", "_range"])
    return met.select((F.col("_begin") + F.col("_nth")).alias("id"), "value")


def read_delimited(spark: SparkSession, path: str, width: int, sep: str = ",") -> DataFrame:
    """(id, v): rows numbered from 0 in file order, one vector to a line."""
    return parse_vectors(numbered_lines(spark, path), width, sep).select("id", "v")


def read_parquet(spark: SparkSession, path: str, id_col: str, vec_col: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def write_planes(planes: DataFrame, path: str) -> None:
    """(plane, w) as text, a plane to a line in plane order, cells parted by a blank; bounded at 63 rows."""
    planes.orderBy("plane").coalesce(1).select(F.array_join(F.transform("w", lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def read_planes(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(plane, w) from text; planes are numbered from 0 in file order."""
    return read_delimited(spark, path, width, " ").select(F.col("id").cast("int").alias("plane"), F.col("v").alias("w"))


def write_topk(topk: DataFrame, path: str) -> None:
    """Ids of a ranked result as text, best first; bounded at k rows."""
    topk.orderBy(F.desc("sim"), "id").coalesce(1).select(F.col("id").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Stored ids, one or more to a line."""
    cells = F.explode(F.split("value", rf"[\s{re.escape(sep)}]+"))
    return spark.read.text(path).select(cells.alias("x")).where("x <> ''").select(F.col("x").cast("bigint").alias("id"))
