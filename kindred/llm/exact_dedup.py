"""Exact deduplication by stateful streaming over content digests.

The texts are digested once; the digests, with the row's identifier and locator, feed a Structured Streaming
aggregation whose state lives in RocksDB on disk, never expires, and is uploaded to the shared folder. A digest
that comes twice, in one micro-batch, in a later one or in a later lot, is a hit: the full bytes of its rows are fetched
from where their locators point and compared, and only then do they count as equal.
Everything is a DataFrame operation; no Python runs on the executors.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.shared import drop, left_join_hot, made, quoted, shared_dir, stored, swept

#: 64-bit words of the filter that picks the texts to compare: its rows never exceed this, so it may be broadcast.
FILTER_WORDS = 1 << 17
#: Micro-batches that a call's digests are dealt to, so that most hits are on state.
BATCHES = 4
#: State in RocksDB, with one bounded cache for all stores of an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store preallocates megabytes
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


#: What a row is known by in a later lot.
_ROW = ("locator", "doc_id", "digest")


def normalised(text: str | Column) -> Column:
    """The text without the characters 20 and 09 to 0D (hexadecimal); null is empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _grouped(digests: DataFrame, named: bool) -> DataFrame:
    """(digest, best, first, group_size); first, the row that came first, is only kept for a state that goes on."""
    best = F.max(F.struct("n_points", F.col("neg_id").isNotNull().alias("has_id"), "neg_id", "neg_lot", "neg_row", "locator")).alias("best")
    first = F.min(F.struct((-F.col("neg_lot")).alias("lot"), (-F.col("neg_row")).alias("row"), "locator")).alias("first")
    return digests.groupBy("digest").agg(best, *[first] * named, F.count(F.lit(1)).alias("group_size"))


def _feed(spark: SparkSession, schema, home: str, files_per_batch: int, named: bool) -> None:
    """Runs the stream over the digests stored in home since its last run; each micro-batch leaves the groups that it touched."""
    if not _exists(spark, f"{home}/groups"):
        _grouped(spark.createDataFrame([], schema), named).write.parquet(f"{home}/groups/batch=-1")
    with _conf(spark, _STATE):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/digests")
        query = (
            _grouped(source, named).writeStream.outputMode("update")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{home}/groups/batch={n}"))
            .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()


def _groups(spark: SparkSession, home: str, after: int) -> DataFrame:
    """The groups as they stand, of those that micro-batches later than `after` have touched."""
    seen = spark.read.parquet(f"{home}/groups").where(F.col("batch") > after)
    fields = [c for c in seen.columns if c not in ("digest", "batch")]
    last = seen.groupBy("digest").agg(F.max(F.struct("batch", *fields)).alias("m"))
    return last.select("digest", *(f"m.{c}" for c in fields))


def _unequal(norm: DataFrame, groups: DataFrame) -> bool:
    """Whether any two texts of norm (digest, norm) share a digest; texts whose digest came once aren't shuffled.

    A bit table of fixed size goes to the executors first and may let others through, which does no harm.
    """
    many = groups.where("group_size > 1").select("digest")
    bits = lambda df: df.withColumn("_h", F.xxhash64("digest")).withColumn("_word", F.pmod(F.shiftright("_h", 6), F.lit(FILTER_WORDS)))
    mask = F.expr("shiftleft(1L, cast(_h & 63 AS int))")
    table = bits(many).groupBy("_word").agg(F.bit_or(mask).alias("_bits"))
    some = bits(norm).join(F.broadcast(table), "_word").where(F.col("_bits").bitwiseAND(mask) != 0)
    seen = some.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))  # combines before the shuffle
    return not seen.where("a <> b").isEmpty()


def _named(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.input_file_name().alias("locator"))
    out = out.withColumn("norm", normalised("text"))
    return out.withColumn("digest", digest(F.col("norm")))


class Lots:
    """The lots that a state folder has: the digests of lot N in digests/lot=N, and, once its stream has ended, its mark in lots/N.

    A lot that died is taken up by the next call: without a finished write of its digests it is as if it hadn't come, since
    no stream starts before; otherwise its stream goes on from its checkpoint, which counts each digest once.
    """

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home, self.n = spark, home, 0
        while _exists(spark, f"{home}/lots/{self.n}/_SUCCESS"):
            self.n += 1
        self.written = _exists(spark, f"{home}/digests/lot={self.n}/_SUCCESS")
        if not self.written and _exists(spark, f"{home}/digests/lot={self.n}"):
            drop(spark, f"{home}/digests/lot={self.n}")

    def digests(self, n: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.home}/digests/lot={n}")

    def mark(self, schema) -> None:
        """The files of the lot that has been fed, and the last micro-batch."""
        batch = self.spark.read.parquet(f"{self.home}/groups").agg(F.max("batch")).first()[0]
        files = self.digests(self.n, schema).groupBy("locator").agg(F.count(F.lit(1)).alias("n"))
        files.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.home}/lots/{self.n}")
        self.n, self.written = self.n + 1, False

    def last_batch(self) -> int:
        """The last micro-batch of the marked lots; a lot without rows may have none."""
        marks = (self.spark.read.parquet(f"{self.home}/lots/{i}").agg(F.max("batch")).first()[0] for i in range(self.n - 1, -1, -1))
        return next((b for b in marks if b is not None), -1)

    def having(self, files: list[str]) -> list[int]:
        """The lots with rows of any of these files."""
        want = set(files)
        return [i for i in range(self.n) if want & {r[0] for r in self.spark.read.parquet(f"{self.home}/lots/{i}").select("locator").collect()}]


def _read(spark: SparkSession, locators: list[str]) -> DataFrame:
    """The files that locators, which are URL-encoded, name; whatever characters their paths have."""
    return spark.read.parquet(*(re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(x)) for x in locators))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None, state: str | None = None, new_only: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal without white space. The row with the most code points in its
    original text stays, then the smallest id (a null id counts as the largest), then the first of repeated rows,
    of which one stays. Null texts are empty, and all empty texts are equal. An empty table gives no rows; other
    columns are ignored. The stream takes files_per_batch files of digests at once, if not given a quarter of them.

    state: a shared folder that keeps the stream's state. A later call, in another session too, goes on with it: docs are then
    a further lot, and the result has the rows of all lots, or of this one alone with new_only; earlier digests aren't read
    for that. The rows must come from Parquet files that stay where they are. A row that an earlier lot has already, by file,
    id and digest, isn't fed again, so a lot that died or is given twice counts once; new_only then gives its rows too.
    """
    spark, before = docs.sparkSession, len(made)
    home, named = state or shared_dir(spark, "exact"), bool(state)
    norm, lots, again, after = _named(docs, id_col, text_col, digest), Lots(spark, home), [], -1
    slim = norm.select(
        "doc_id", "digest", F.length("text").alias("n_points"), (-F.col("doc_id")).alias("neg_id"), F.lit(0).cast("bigint").alias("neg_lot"),
        (-F.monotonically_increasing_id()).alias("neg_row"), "locator",
    )
    schema = slim.schema
    per_batch = lambda: files_per_batch or max(1, -(-len(lots.digests(lots.n, schema).inputFiles()) // BATCHES))
    if state:
        if lots.written:  # its stream didn't end
            _feed(spark, schema, home, per_batch(), named)
            lots.mark(schema)
        after, again = lots.last_batch(), lots.having(docs.inputFiles())
    lot = lots.n
    fresh = slim.withColumn("neg_lot", F.lit(-lot).cast("bigint"))
    if again:
        seen = reduce(DataFrame.union, [lots.digests(i, schema) for i in again]).select(*(F.col(c).alias(f"_{c}") for c in _ROW)).distinct()
        fresh = fresh.join(seen, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ROW]), "left_anti")
    fresh.write.mode("overwrite").parquet(f"{home}/digests/lot={lot}")
    if state and not lots.digests(lot, schema).where("locator = ''").isEmpty():
        drop(spark, f"{home}/digests/lot={lot}")
        raise ValueError("rows without a file can't be fetched by a later lot")
    _feed(spark, schema, home, per_batch(), named)
    if state:
        lots.mark(schema)
    groups = stored(_groups(spark, home, after), f"{shared_dir(spark, 'exact-groups')}/{lot}")
    if not state:
        drop(spark, f"{home}/state")
        drop(spark, f"{home}/groups")
    if lot:  # an earlier text of each hit, fetched by its locator; the earlier texts of a digest have been compared before
        hit = groups.where((F.col("group_size") > 1) & (F.col("first.lot") < lot))
        files = [r[0] for r in hit.select("first.locator").distinct().collect()]  # files, not rows
        old = _read(spark, files) if files else docs.where(F.lit(False))
        norm = norm.select("digest", "norm").union(_named(old, id_col, text_col, digest).select("digest", "norm"))
    every = spark.read.schema(schema).parquet(*(f"{home}/digests/lot={i}" for i in ([*again, lot] if new_only else range(lot + 1))))
    digests = every.where((F.col("neg_lot") == -lot) | F.col("locator").isin(docs.inputFiles())) if new_only and again else every
    if digest is not sha256 or _unequal(norm, groups):
        return _by_bytes(_fed(spark, lots, schema, id_col, text_col, digest) if state else norm, docs.inputFiles() if new_only else None)
    if lot and (again or not new_only):
        groups = stored(_groups(spark, home, -1), f"{shared_dir(spark, 'exact-all')}/{lot}")
    n = digests.count()
    best = groups.select("digest", F.struct("best", "group_size").alias("g"))
    joined = left_join_hot(digests.select("doc_id", "digest", "neg_lot", "neg_row"), best, "digest", n, groups.select("digest", F.col("group_size").alias("n")))
    kept = (F.col("neg_lot") == F.col("g.best.neg_lot")) & (F.col("neg_row") == F.col("g.best.neg_row"))
    out = joined.select("doc_id", (-F.col("g.best.neg_id")).alias("keep_id"), F.col("g.group_size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return swept(out, before)


def _fed(spark: SparkSession, lots: Lots, schema, id_col: str, text_col: str, digest) -> DataFrame:
    """The texts of all rows that the lots have, from their files."""
    digests = reduce(DataFrame.union, [lots.digests(i, schema) for i in range(lots.n)])
    files = [r[0] for r in digests.select("locator").distinct().collect()]
    keys = digests.select(*(F.col(c).alias(f"_{c}") for c in _ROW)).distinct()
    return _named(_read(spark, files), id_col, text_col, digest).join(keys, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ROW]), "left_semi")


def _by_bytes(norm: DataFrame, files: list[str] | None) -> DataFrame:
    """The answer where different texts share a digest: groups of whole normalised texts; files: only the rows of these."""
    rows = norm.withColumn("row", F.struct(F.length("text").alias("n"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg_id"), (-F.monotonically_increasing_id()).alias("neg_row")))
    best = rows.groupBy("norm").agg(F.max("row").alias("best"), F.count(F.lit(1)).alias("group_size"))
    rows = rows if files is None else rows.where(F.col("locator").isin(files))
    return rows.join(best, "norm").select(
        "doc_id", (-F.col("best.neg_id")).alias("keep_id"), "group_size", (F.col("row.neg_row") == F.col("best.neg_row")).alias("kept"), F.sha2("norm", 256).alias("text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of rows repeated with one id and text, one
    stays (the one with the most code points, then the least text)."""
    spark, before = docs.sparkSession, len(made)
    rows = stored(exact_dedup(docs, id_col, text_col), shared_dir(spark, "exact-rows"))
    many = rows.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("many")).where("many")
    kept = rows.where("kept").select("doc_id", "text_sha256").join(many.withColumnRenamed("doc_id", "again"), F.col("doc_id").eqNullSafe(F.col("again")), "left")
    kept = kept.select("doc_id", "text_sha256", F.col("many").isNotNull().alias("many"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    same = held["id"].eqNullSafe(kept["doc_id"]) & (~kept["many"] | (F.sha2(normalised(held["text"]), 256) == kept["text_sha256"]))
    stay = held.join(kept, same)
    one = stay.where("many").groupBy("id", "text_sha256").agg(F.min_by("row", F.struct(-F.length("text"), "text")).alias("row"))
    return swept(stay.where("NOT many").select("row.*").union(one.select("row.*")), before)
