"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again, in a number of files that follows the size of what the stage read. All but the last
return the columns of ``documents``, extra ones included, whatever their names. An empty table passes through
all stages as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphspark.llm import byte_bpe, line_dedup, mixing, quality, simhash
from glyphspark.llm._common import discard, file_count, importable, stored


def _few(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.coalesce(file_count(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the n-gram verdict reject: null, empty and short texts among
    them. Very long texts are read whole; equal texts get one verdict, so repeated rows stay or go together,
    as do rows without an id; a score equal to the threshold stays."""
    importable(spark)
    return _few(quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that resemble an earlier one; documents stay, shorter, and empty if all their lines go.
    Null texts and rows without an id stay as they are; rows of one doc_id lose the same lines; which of
    several earlier lines matches does not matter."""
    return _few(line_dedup.dedup_lines(docs), docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that of the smallest id, nulls last, of equal rows any.
    Null and empty texts are near copies of each other; very long texts are read whole."""
    importable(spark)
    return _few(simhash.keep_one(docs), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights. A null source is one of its own;
    null and empty texts have size 0 and are drawn like others; equal rows are drawn apart."""
    return _few(mixing.mix(docs), docs)


def byte_bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the documents and decode them again: doc_id, n_tokens and digests of ids and bytes, a row for
    each row. A null text is an empty one; very long texts are coded whole."""
    importable(spark)
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _few(byte_bpe.digest(coded), docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_deduplication", line_deduplication),
    ("near_deduplication", near_deduplication),
    ("source_mixing", source_mixing),
    ("byte_bpe_coding", byte_bpe_coding),
]

#: Hashed n-grams, SimHash and BPE have no SQL form; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # what the stage before wrote; the input was not written here
    return docs
