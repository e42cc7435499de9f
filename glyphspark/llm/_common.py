"""Helpers shared by the training-data operators: word rules, shared storage, Arrow plumbing."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chars import shared_dir

#: A word is a run of characters other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glyphspark-{label}-{uuid.uuid4().hex}"


#: Bytes of a source for each file of the tables that are made from it.
FILE_BYTES = 128 << 20


def file_count(source: DataFrame) -> int:
    """Files (and tasks of the last stage) for a table made from ``source``: one a core or more, and more
    as the source grows. A small table over hundreds of partitions would be as many tiny files, for each of
    which the file system's calls cost more than its rows."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(source.sparkSession.sparkContext.defaultParallelism, min(size // FILE_BYTES, 1 << 20))


#: Where the shared folder is a local path, no checksum files and no marker: each would be one more process
#: that the JVM starts for its permissions. Other file systems do not look at these.
_PLAIN_LOCAL = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in at most ``files`` files, and read it back.

    Cuts the lineage: what is read later survives the loss of any executor.
    """
    path = fresh_path(df.sparkSession, label)
    writer = (df if files is None else df.coalesce(files)).write.options(compression="zstd", **_PLAIN_LOCAL)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._glyph_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once no later result reads it, and let Spark remove the shuffle
    files of finished jobs, which it does when the driver collects its garbage."""
    spark = tables[0].sparkSession
    for path in filter(None, (getattr(df, "_glyph_path", None) for df in tables)):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed on the executors or shipped with ``--py-files``.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def utf8(c: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that Python objects of few rows live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, list | pa.Array]], rows: int = 256) -> DataFrame:
    """``mapInArrow`` over small slices: ``fn`` turns one into the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            cols = fn(part)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in arrow for c in [cols[f.name]]], schema=arrow
            )

    return df.mapInArrow(run, schema)
