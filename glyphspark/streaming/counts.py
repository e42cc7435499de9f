"""Incremental n-gram counts with Structured Streaming.

Counts are additive, so each micro-batch adds its own table; the batch's number makes a repeated batch
overwrite itself, and reading sums the tables. Contexts do not cross documents here, since documents
arrive in no order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def count_batch(documents: DataFrame, ks: tuple[int, ...], text: str = "text") -> DataFrame:
    """k, ctx, ch, c within each document."""
    k = max(ks)
    rows = documents.where(F.col(text).isNotNull()).select(F.regexp_extract_all(text, F.lit("(?s).{1,128}"), F.lit(0)).alias("pieces"))
    cut = rows.select(F.explode(F.transform("pieces", lambda p, i: F.struct(F.when(i == 0, "").otherwise(F.right(F.get("pieces", i - 1), F.lit(k))).alias("left"), p.alias("p")))).alias("x"))
    cut = cut.select(F.length("x.left").alias("h"), F.concat("x.left", "x.p").alias("s"), F.explode(F.sequence(F.lit(1), F.length("x.p"))).alias("j"))
    j, h = F.col("j"), F.col("h")
    whole = cut.select(F.substring("s", h + j, F.lit(1)).alias("ch"), F.substring("s", F.greatest(F.lit(1), h + j - k), F.least(F.lit(k), h + j - 1)).alias("ctx"))
    whole = whole.groupBy("ctx", "ch").agg(F.count(F.lit(1)).alias("c"))
    each = whole.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where(F.length("ctx") >= F.col("k"))
    return each.groupBy("k", F.right("ctx", F.col("k")).alias("ctx"), "ch").agg(F.sum("c").alias("c"))


def start(stream: DataFrame, path: str, checkpoint: str, ks: tuple[int, ...] = (1, 2, 4)) -> StreamingQuery:
    """Count a stream of documents into ``path``, until what is there has been read."""

    def add(batch: DataFrame, number: int) -> None:
        count_batch(batch, ks).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("k", "ctx", "ch").agg(F.sum("c").alias("c"))
