"""The corpus pipeline: language ID, Jaccard join, benchmark decontamination, secret scans, packing.

Each stage works on what the one before kept; all but the last return documents with their columns. `run` writes
each stage's result to the shared folder and reads it again, so that a lost executor costs one stage at most.

A stage's input is a written table: when a stage begins, the result of the one before it has been written, so it first deletes the tables that
that one wrote for itself. Disk use is that of one stage, not of all.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, jaccard, langid, packing, secret_scan
from cairn.llm.common import discard, in_name_of, materialize, release, small_batches

TOKENIZER = "word_bpe_49k.json"
#: Rows of a batch that goes to Python while a stage writes its tables. The stages share their executors' memory, and what one stage's batches took is not all given back for the next.
BATCH_ROWS = 1000
#: Words that a worker holds while it packs, for the same reason fewer than where packing runs alone.
CACHED_WORDS = 300_000


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, after the tables of the stage before it are deleted."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs, of="pipeline")
        with in_name_of("pipeline"), small_batches(spark, BATCH_ROWS):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    return langid.keep_identified(docs)


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component."""
    return jaccard.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that look live; n_chars follows the text."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    p = packing.pack(docs, public_tokenizers.path(TOKENIZER), cached_words=CACHED_WORDS)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("secrets", secrets), ("packing", pack)]

#: Language models and tokenizers have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    release(spark, of="pipeline")
    return docs
