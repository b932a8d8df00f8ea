"""Working tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder is made and set if all runs on this machine; else it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once, unless PYTHONPATH already leads them to it."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or spark.sparkContext.master.startswith("local[") or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # the driver serves the file from where it lies, so it stays until the process ends
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='kindred-')}/kindred", "zip", root, "kindred"))
    _shipped.add(app)


class Work:
    """The working tables of one call, in a folder of their own; leaving the `with` block removes them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.home = spark, f"{shared_root(spark)}/{name}-{uuid4().hex}"

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """df written once as Parquet and read again: cuts its lineage and survives a lost executor."""
        path = f"{self.home}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
