"""What the operators share: folders that all executors reach, and materialised tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter
from pathlib import Path
from uuid import uuid4
from weakref import WeakSet

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Made(threading.local):
    """Folders that this thread has made and not removed, in their order: calls within a call come after it, and calls of
    other threads have lists of their own, so what a call made are those since it began."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)

    def since(self, before: int) -> list[str]:
        return self.paths[before:]


made = Made()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one is made and set if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid4().hex}"
    made.paths.append(path)
    return path


#: Spark removes the shuffle files of a query when it ends; otherwise they stay until the driver happens to collect garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), [0, "false"]


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in the block go with each write; the last of several threads restores the setting."""
    with _lock:
        if not _writers[0]:
            _writers[1] = spark.conf.get(FREE, "false")
            spark.conf.set(FREE, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(FREE, _writers[1])


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written once as Parquet and read again: cuts its lineage and survives a lost executor. Its shuffle files go at once."""
    with freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder that stored() made, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def swept(out: DataFrame, before: int) -> DataFrame:
    """out, once the folders made since there were `before` of them are gone, but for those that out itself reads."""
    read = out.inputFiles()
    clear(out.sparkSession, [path for path in made.since(before) if not any(path.split("/")[-1] in x for x in read)])
    return out


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders of this thread."""
    for path in paths:
        drop(spark, path)
        made.paths.remove(path)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_key(text: str | Column) -> Column:
    """16 bytes that stand for a text (the head of its SHA-256)."""
    return F.substring(F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256)), 1, 16)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, unless PYTHONPATH already leads them to it."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # the driver serves the file from where it lies, so it stays until the process ends
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='kindred-')}/kindred", "zip", root, "kindred"))
    _shipped.add(app)


#: 64-bit words of the bit table in flagged(): its rows never exceed this, so it may be broadcast whatever the tables' size.
FLAG_WORDS = 1 << 17


def flagged(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with `_flag`: false only where `key` surely isn't among keys[key].

    A bit table of fixed size, broadcast. It spares most rows a shuffle when few keys match, and lets all
    through when very many do; whoever joins afterwards settles it.
    """
    at = F.xxhash64(F.col(key))
    word, bit = F.pmod(F.shiftright(at, 6), F.lit(FLAG_WORDS)), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 AS int))")
    table = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    out = df.withColumn("_word", word).join(F.broadcast(table), "_word", "left")
    return out.withColumn("_flag", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def left_join_few(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df left-joined with table on a key that is unique in table; rows that can't match aren't shuffled."""
    marked = flagged(df, table, key)
    rest = [c for c in table.columns if c != key]
    types = dict(table.dtypes)
    hit = marked.where("_flag").drop("_flag").join(table, key, "left")
    miss = marked.where("NOT _flag").drop("_flag").withColumns({c: F.lit(None).cast(types[c]) for c in rest})
    return hit.select(*df.columns, *rest).unionByName(miss.select(*df.columns, *rest))


#: Keys that have more than a part in so many of all rows are hot; there can't be more of them than this.
HOT = 10_000


def left_join_hot(df: DataFrame, table: DataFrame, key: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """df, of `total` rows and stored, left-joined with table on a key that is unique in table.

    Keys with more than total / HOT rows of df, HOT at most, are looked up in a broadcast excerpt; the others are
    shuffled, so that no key brings one task more than that part of the rows. counts: (key, n) where known.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") * HOT > total + 10 * HOT).select(key)
    rest = [c for c in table.columns if c != key]
    types = dict(table.dtypes)
    excerpt = hot.join(table, key, "left").withColumn("_hot", F.lit(True))
    marked = df.join(F.broadcast(excerpt), key, "left")
    warm = marked.where(F.col("_hot") | F.col(key).isNull()).select(*df.columns, *rest)
    cold = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*df.columns)
    return warm.unionByName(cold.join(table, key, "left").select(*df.columns, *(F.col(c).cast(types[c]) for c in rest)))


_tables: WeakSet[Recent] = WeakSet()


def forget() -> None:
    """Empties the tables that another operator has left in this worker process, which Spark uses again."""
    for t in list(_tables):
        t.now, t.older = {}, {}


class Recent:
    """A table of bounded size: when full it becomes the older half, from which what is asked for again moves back."""

    def __init__(self, limit: int) -> None:
        self.limit, self.now, self.older = limit, {}, {}
        _tables.add(self)

    def turn(self) -> None:
        """Makes room if the table is full."""
        if len(self.now) > self.limit:
            self.older, self.now = self.now, {}

    def missing(self, keys: set) -> list:
        """The keys that are in neither half; the others are in `now` until the next turn."""
        now, older, out = self.now, self.older, []
        for k in keys.difference(now):
            if k in older:
                now[k] = older[k]
            else:
                out.append(k)
        return out

    def joined(self, keys: list) -> bytes:
        """The values of the keys, one after another."""
        return b"".join(itemgetter(*keys)(self.now)) if len(keys) > 1 else b"".join(map(self.now.__getitem__, keys))
