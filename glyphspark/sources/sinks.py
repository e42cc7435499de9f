"""Writers: CSV that keeps one-character keys, key-value files, configurations, hex-token lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header; blanks, quotes and commas in keys come back as they were. Doubles are rounded
    half to even to ``decimals`` places, arrays written as lists in brackets."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double" and decimals is not None:
            c = F.bround(c, decimals)
        elif kind.startswith("array"):
            c = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
        cols.append(c.alias(name))
    writer = df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def key_values(df: DataFrame) -> DataFrame:
    """stat, value rows of a table of one row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("r")).select("r.*")


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    import json

    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def hex_token(ch: str | Column) -> Column:
    """Code point in lower-case hexadecimal, four digits at least."""
    shown = F.lower(F.hex(F.ascii(ch)))
    return F.when(F.length(shown) < 4, F.lpad(shown, 4, "0")).otherwise(shown)


def training_lines(characters: DataFrame, width: int = 1000) -> DataFrame:
    """corpus, line_no, line: ``width`` hex tokens a line, for language models that read words."""
    rows = characters.select("corpus", F.floor(F.col("pos") / width).alias("line_no"), "pos", hex_token("ch").alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda r: r["t"])
    return rows.groupBy("corpus", "line_no").agg(F.array_join(listed, " ").alias("line"))


#: Lines that go to a worker as one block, and characters of the corpora for each part of the blocks.
BLOCK, PART_CHARS = 1000, 32_000_000


def text_lines(located: DataFrame, ends: DataFrame, width: int = 1000) -> DataFrame:
    """As ``training_lines``, of located documents (corpus, start, text) up to the place ``high`` of ``ends``.
    Texts are cut at blocks of ``BLOCK`` lines and dealt out and put in order by these; a worker joins what
    follows each other and writes whole lines as tokens."""
    size, parts = width * BLOCK, 1 + (ends.agg(F.sum("high")).first()[0] or 0) // PART_CHARS
    rows = located.join(F.broadcast(ends), "corpus").where("start < high")  # a row a corpus
    rows = rows.withColumn("text", F.left("text", F.least(F.length("text").cast("long"), F.col("high") - F.col("start")).cast("int"))).where("text <> ''")
    end = F.col("start") + F.length("text")
    low = lambda b: F.greatest(F.col("start"), b * size)
    piece = lambda b: F.substring("text", (low(b) - F.col("start") + 1).cast("int"), (F.least(end, (b + 1) * size) - low(b)).cast("int"))
    blocks = F.transform(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size)), lambda b: F.struct(b.alias("block"), low(b).alias("from"), piece(b).alias("text")))
    rows = rows.select("corpus", F.explode(blocks).alias("b")).select("corpus", "b.*").repartition(int(parts), "corpus", "block").sortWithinPartitions("corpus", "block", "from")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        of, at, held = None, 0, []  # corpus and block, place of the first character that is held, and what is held

        def lines(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at, held
            text = "".join(held)
            whole = len(text) if last else (at + len(text)) // width * width - at
            if whole > 0:
                known.update((c, f"{ord(c):04x}") for c in set(text) if c not in known)
                shown = [text[i : i + width] for i in range(0, whole, width)]  # the first one begins a line
                line = pa.array([" ".join([known[c] for c in t]) for t in shown], pa.string())
                no = pa.array(range(at // width, at // width + len(shown)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([of[0]] * len(shown), pa.string()), no, line], names=["corpus", "line_no", "line"])
                at, text = at + whole, text[whole:]
            held = [text] if text else []

        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                for name, block, start, text in zip(*(part.column(c).to_pylist() for c in ("corpus", "block", "from", "text")), strict=True):
                    if (name, block) != of:
                        yield from lines(True)
                        of, at = (name, block), start
                    held.append(text)
                yield from lines(False)
        yield from lines(True)

    return rows.mapInArrow(tokens, "corpus string, line_no long, line string")


def ngram_label(k: str | Column) -> Column:
    """Name of the n-grams of a context of ``k`` characters."""
    c = F.col(k) if isinstance(k, str) else k
    return F.when(c == 1, "bigram").when(c == 2, "trigram").otherwise(F.concat((c + 1).cast("string"), F.lit("-gram")))


def top(df: DataFrame, by: str, n: int | None = None, *ties: str) -> DataFrame:
    """Rows in descending order of a column whose nulls count as 0, the first ``n`` of them if given; ties
    by further columns. An empty table gives an empty one."""
    ordered = df.orderBy(F.coalesce(F.col(by), F.lit(0)).desc(), *ties)
    return ordered if n is None else ordered.limit(n)


def shown(ch: str | Column) -> Column:
    """A character as it is printed in a table: quoted, with blanks by their escapes."""
    c = F.col(ch) if isinstance(ch, str) else ch
    escaped = F.when(c == "\n", "\\n").when(c == "\t", "\\t").when(c == "\r", "\\r").when(c == "'", "\\'").when(c == "\\", "\\\\").otherwise(c)
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def text_table(df: DataFrame, widths: dict[str, int], decimals: int = 4) -> DataFrame:
    """One column ``line``: a row of the table as text, numbers to the right, the rest to the left."""
    cells, kinds = [], dict(df.dtypes)
    for name, width in widths.items():
        c = F.col(f"`{name}`")
        number = kinds[name] in ("double", "float", "int", "bigint")
        value = F.coalesce(F.format_string(f"%.{decimals}f", c.cast("double")) if kinds[name] in ("double", "float") else c.cast("string"), F.lit("-"))
        pad = F.lpad if number else F.rpad
        cells.append(F.when(F.length(value) > width, value).otherwise(pad(value, width, " ")))
    return df.select(F.concat_ws(" ", *cells).alias("line"))


def heading(widths: dict[str, int], kinds: dict[str, str]) -> str:
    """The line above a text table."""
    return " ".join(name.rjust(w) if kinds[name] in ("double", "float", "int", "bigint") else name.ljust(w) for name, w in widths.items())
