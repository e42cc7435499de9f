"""A cache of surprisal and coverage tables: Parquet by corpus hash and order.

Orders that are there are not computed again; a rerun overwrites just the orders it brings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Cache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._at(table))
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.parquet(self._at(table)) if there else None

    def put(self, table: str, rows: DataFrame, corpus_hash: str) -> None:
        """Rows with a column k replace what the cache has of the same corpus and orders."""
        out = rows.withColumns({"corpus_hash": F.lit(corpus_hash), "ts": F.current_timestamp()})
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("corpus_hash", "k").parquet(self._at(table))

    def put_missing(self, table: str, rows: DataFrame, corpus_hash: str) -> None:
        """Only orders that are not there yet."""
        done = self.orders(table, corpus_hash)
        self.put(table, rows.where(~F.col("k").isin(*done)) if done else rows, corpus_hash)

    def get(self, table: str, corpus_hash: str, ks: Iterable[int] | None = None) -> DataFrame | None:
        rows = self._read(table)
        if rows is None:
            return None
        rows = rows.where(F.col("corpus_hash") == corpus_hash)
        return rows if ks is None else rows.where(F.col("k").isin(*ks))

    def orders(self, table: str, corpus_hash: str) -> list[int]:
        rows = self.get(table, corpus_hash)
        return [] if rows is None else sorted(r.k for r in rows.select("k").distinct().collect())

    def missing(self, table: str, corpus_hash: str, ks: Iterable[int]) -> list[int]:
        done = set(self.orders(table, corpus_hash))
        return [k for k in ks if k not in done]

    def put_range(self, corpus_hash: str, reliable: int, effective: int, ks: Iterable[int]) -> None:
        row = self.spark.createDataFrame([(reliable, effective, list(ks), corpus_hash)], "reliable_kmax int, effective_kmax int, k_values array<int>, corpus_hash string")
        row = row.withColumn("k_values_json", F.to_json("k_values"))
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_hash").parquet(self._at("k_range"))

    def get_range(self, corpus_hash: str) -> tuple[int, int, list[int]] | None:
        rows = self._read("k_range")
        row = None if rows is None else rows.where(F.col("corpus_hash") == corpus_hash).select("reliable_kmax", "effective_kmax", F.from_json("k_values_json", "array<int>").alias("ks")).first()
        return None if row is None else (row[0], row[1], list(row[2]))


def corpus_hash(documents: DataFrame, exact: bool = False) -> str:
    """First 16 hex digits of a SHA-256: of the whole text if ``exact`` (small corpora, one value), else
    of the documents' own digests in order, which no row has to hold together as text."""
    rows = documents.select("corpus", "doc_id", F.col("text").alias("t") if exact else F.sha2(F.col("text").cast("binary"), 256).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("corpus", "doc_id", "t"))), lambda r: r["t"]), "")
    if exact:
        return rows.agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)).first()[0]
    # In two steps, so that a range of documents gives one digest.
    part = rows.groupBy("corpus", F.floor(F.col("doc_id") / 4096).alias("doc_id")).agg(F.sha2(joined.cast("binary"), 256).alias("t"))
    return part.agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)).first()[0]
