"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from kindred.llm.shared import clear, made, quoted, shared_dir, ship, stored


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage; the working tables that its result reads stay until run() has stored it, or the caller removes them."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, doesn't reject; null texts are scored as
    empty, repeated rows alike."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space; null texts are empty, so one of these stays."""
    return exact_dedup.keep_one(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on shingles of five words; those without
    words all stay."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words and more that come more than once; n_chars follows the text.

    Null texts stay null, and repeated rows lose the same; other columns stay as they are, whatever their names."""
    cut = substring_dedup.cut_rows(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return cut.select(*(new.get(c, F.col(f"row.{quoted(c)}")) for c in docs.columns))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens; a null or empty text is its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: Trees, tokenizers and cover of windows aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is stored in the shared folder and read again."""
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline")
    for name, f in STAGES:
        before = len(made)
        docs = stored(f(spark, docs, sf_dir), f"{home}/{name}")
        clear(spark, made.since(before))
    return docs
