"""Readers of text corpora: files, directories, archives and panels in CSV."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANEL_SCHEMA = "CG double, log2k double, Structural int, log2k_x_S double, logFreq double, char_id string"


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, strict: bool = False) -> DataFrame:
    """path, text of every file, as UTF-8. Malformed bytes become U+FFFD, or fail if ``strict``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.load(path).select("path", "content")
    text = F.col("content").cast("string")
    return raw.select("path", (F.validate_utf8(text) if strict else F.make_valid_utf8(text)).alias("text"))


def numbered(files: DataFrame, by: str = "path") -> DataFrame:
    """doc_id in the order of names, for ``corpus``. The window holds names alone."""
    names = files.select(by).withColumn("doc_id", F.row_number().over(Window.orderBy(by)).cast("long") - 1)
    return files.join(names, by)


def trim_markers(text: Column, start: str, end: str) -> Column:
    """What lies between the first ``start`` and the last ``end``; a side is cut only if its marker
    stands after the text's first character."""
    first = F.instr(text, start)
    head = F.when(first > 1, F.substring(text, first, F.length(text))).otherwise(text)
    back = F.instr(F.reverse(head), end[::-1])
    at = F.length(head) - back - len(end) + 1
    return F.when((back > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)


def capped_lines(lines: DataFrame, limit: int, order: str = "line_no", text: str = "text") -> DataFrame:
    """Lines that are neither blank nor headings (``=``), up to ``limit`` characters in all; the last one
    is cut. The running length is taken in two steps, over ranges of the order and within them."""
    kept = lines.where((F.trim(text) != "") & ~F.startswith(F.trim(text), F.lit("=")))
    ranged = kept.withColumn("_range", F.floor(F.col(order) / 4096))
    sums = ranged.groupBy("_range").agg(F.sum(F.length(text)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")).where(F.col("_base") < limit)
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(bases, "_range").withColumn("_at", F.col("_base") + F.coalesce(F.sum(F.length(text)).over(inside), F.lit(0)))
    room = (F.lit(limit) - F.col("_at")).cast("int")
    return placed.where(F.col("_at") < limit).withColumn(text, F.left(text, room)).drop("_range", "_base", "_at")


def read_zip(spark: SparkSession, path: str, extension: str, part: str | None = None) -> DataFrame:
    """archive, member, text of the members with this extension (minified ones left out)."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches):
        for batch in batches:
            out = []
            for archive, content in zip(batch.path, batch.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(extension) and not name.endswith(".min" + extension) and (part is None or part in name):
                            out.append((archive, name, z.read(name).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["archive", "member", "text"])

    return raw.mapInPandas(members, "archive string, member string, text string")


def read_panel(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    """A regression panel in CSV as corpus-less rows; characters such as quotes and spaces survive."""
    rows = spark.read.schema(PANEL_SCHEMA).option("header", True).option("escape", '"').option("multiLine", True)
    rows = rows.option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).csv(path)
    return rows.select("char_id", F.round(F.pow(F.lit(2.0), "log2k")).cast("int").alias("k"), F.col("CG").alias("cg"), "log2k", F.col("Structural").alias("structural"), F.col("log2k_x_S").alias("log2k_x_s"), F.col("logFreq").alias("logfreq"))
