"""From documents to characters with their positions, splits and left contexts.

A corpus is the concatenation of its documents by doc_id, each followed by a separator. Nothing is
concatenated: a document knows the position of its first character (a prefix sum of lengths) and its
halo (the last K characters before it), and is cut into short pieces that are exploded on their own.

Documents are told apart by corpus, doc_id, two hashes and the length of their text. Those of one doc_id
stand in the order of their hashes, those without one after all others. Equal rows are one narrow row
with a count until their positions are known, so neither a repeated nor a missing doc_id loses, crosses
or multiplies documents. Prefix sums run in two steps, over the partitions of a range partitioning and
within them, so no window holds all documents, however their ids are spread.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strata import NAMES, with_strata
from . import counting

#: Characters of a piece: short enough for substring to be cheap, long enough to amortise the halo.
PIECE = 128
#: Documents of a range of the prefix sums, and ranges at most.
RANGE_ROWS, MAX_RANGES = 50_000, 4096
#: Documents whose positions and halos are broadcast; more are joined by a shuffle.
MAX_BROADCAST_DOCS = 200_000

_own_dirs: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; else a temporary one in local mode, the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local"):
            _own_dirs[app] = tempfile.mkdtemp(prefix="glyphspark-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        else:
            _own_dirs[app] = spark.conf.get("spark.sql.warehouse.dir")
    return _own_dirs[app].rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back."""
    path = os.path.join(shared_dir(df.sparkSession), f"glyphspark-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def corpus(docs: DataFrame, text: str = "text", doc_id: str | Column = "doc_id", name: str | Column = "all", separator: str = "\n", language: str | None = None) -> DataFrame:
    """corpus, doc_id, text of a table of documents; ``name`` is the corpus' name or a column with it.
    Null texts, and rows whose name is null, are left out. With a ``language`` each document gets the
    strata of its characters, a letter for each. Bytes that are no UTF-8 become U+FFFD."""
    label, key = F.lit(name) if isinstance(name, str) else name, F.col(doc_id) if isinstance(doc_id, str) else doc_id
    out = docs.where(F.col(text).isNotNull()).select(label.alias("corpus"), key.cast("long").alias("doc_id"), F.concat(F.make_valid_utf8(F.col(text)), F.lit(separator)).alias("text"))
    out = out.where(F.col("corpus").isNotNull())
    return out.withColumn("strata", with_strata("text", language)) if language else out


#: What tells documents apart, and the order in which they stand.
KEY = ("corpus", "doc_id", "h1", "h2", "len")


def _keyed(documents: DataFrame) -> DataFrame:
    """Documents with their key; those without a character take no place and are left out."""
    return documents.withColumns({"h1": F.xxhash64("text"), "h2": F.crc32(F.col("text").cast("binary")), "len": F.length("text").cast("long")}).where("len > 0")


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_last(), F.col("h1").asc(), F.col("h2").asc(), F.col("len").asc()]


@dataclass(frozen=True)
class Placed:
    """Where documents stand: KEY, m (equal rows), start and halo of the first of them."""

    table: DataFrame
    rows: int
    repeats: bool


def place(documents: DataFrame, k: int, wrap: bool = False, trim: int = 0, ranges: int | None = None) -> Placed:
    """The place of every document. The halo holds the ``k`` characters before it, fewer at the corpus'
    start unless the corpus' end, less ``trim`` characters, is to go on there (``wrap``)."""
    keep = k + trim
    narrow = _keyed(documents).select(*KEY, F.right("text", F.lit(keep)).alias("tail")).groupBy(*KEY, "tail").agg(F.count(F.lit(1)).alias("m"))
    n = ranges or min(MAX_RANGES, 1 + documents.count() // RANGE_ROWS)
    dealt = stored(narrow.repartitionByRange(n, F.col("corpus"), *_order()).withColumn("range", F.spark_partition_id().cast("long")), "places-dealt")
    # The end of a group of equal rows, the end of the rows before it, and the sum of their lengths.
    dealt = dealt.withColumns({
        "size": F.col("m") * F.col("len"),
        "ends": F.when(F.col("m") == 1, F.col("tail")).otherwise(F.right(F.repeat("tail", F.least(F.col("m"), F.lit(keep)).cast("int")), F.lit(keep))),
    })
    joined = lambda c, w: F.right(F.concat_ws("", F.collect_list(c).over(w)), F.lit(keep))
    inside = Window.partitionBy("corpus", "range").orderBy(*_order())
    own = dealt.withColumns({
        "before": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "halo": joined("ends", inside.rowsBetween(-keep, -1)),
        "end": joined("ends", inside.rowsBetween(-keep + 1, 0)),
    })
    ranked = F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2", "len")
    sums = own.groupBy("corpus", "range").agg(F.sum("size").alias("size"), F.max_by("end", ranked).alias("end"))
    upto = Window.partitionBy("corpus").orderBy("range")  # MAX_RANGES rows of a corpus at most
    sums = sums.select(
        "corpus", "range", F.coalesce(F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), joined("end", upto.rowsBetween(-keep, -1)).alias("earlier"), "end"
    )
    if wrap:
        tail = F.max_by(F.right(F.concat("earlier", "end"), F.lit(keep)), "range")
        last = sums.groupBy("corpus").agg(F.right(F.left(tail, F.length(tail) - trim), F.lit(k)).alias("last"))
        sums = sums.join(F.broadcast(last), "corpus").withColumn("earlier", F.concat("last", "earlier"))
    full = own.drop("end").join(F.broadcast(sums.select("corpus", "range", "base", "earlier")), ["corpus", "range"])
    table = stored(full.select(*KEY, "m", (F.col("base") + F.col("before")).alias("start"), F.right(F.concat("earlier", "halo"), F.lit(k)).alias("halo")), "places")
    rows, most = table.agg(F.count(F.lit(1)), F.max("m")).first()
    return Placed(table, rows, (most or 1) > 1)


def letters(documents: DataFrame) -> DataFrame:
    """corpus, ch, n: how often the whole corpus has each character."""
    return counting.letters(documents).groupBy("corpus", "ch").agg(F.sum("n").alias("n"))


def stats(letters: DataFrame) -> DataFrame:
    """corpus, n, n_tr, n_vl, vocab_size (distinct characters of the whole corpus) from ``letters``."""
    per = letters.groupBy("corpus").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("vocab_size"))
    return per.select("corpus", "n", F.floor(F.lit(0.8) * F.col("n")).alias("n_tr"), F.floor(F.lit(0.1) * F.col("n")).alias("n_vl"), "vocab_size")


def spread(documents: DataFrame) -> DataFrame:
    """Few documents dealt out to all cores, since a small file is one partition; many as they are."""
    if documents.count() > MAX_BROADCAST_DOCS:
        return documents
    return documents.repartition(documents.sparkSession.sparkContext.defaultParallelism, "corpus", "doc_id", F.xxhash64("text"))


def _with_places(documents: DataFrame, k: int, placed: Placed, window: DataFrame | None) -> DataFrame:
    """Documents with start and halo; with a ``window`` (corpus, low, high) only those that reach into it."""
    table = placed.table
    if window is not None:
        reach = (F.col("start") < F.col("high")) & (F.col("start") + F.col("m") * F.col("len") > F.col("low"))
        table = table.join(F.broadcast(window), "corpus").where(reach).drop("low", "high")
    if placed.rows <= MAX_BROADCAST_DOCS:
        table = F.broadcast(table)
    docs, table = _keyed(documents).alias("d"), table.alias("p")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) if c == "doc_id" else F.col(f"d.{c}") == F.col(f"p.{c}") for c in KEY]
    full = docs.join(table, same).select("d.*", "p.m", "p.start", "p.halo")
    if not placed.repeats:
        return full.drop("m")
    once = full.where("m = 1").drop("m")
    # Equal rows are one here; their copies are dealt out in about as many blocks as a block has copies.
    some = full.where("m > 1").distinct().withColumn("_step", F.ceil(F.sqrt(F.col("m").cast("double"))).cast("long"))
    blocks = some.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.col("_step"))))
    blocks = blocks.repartition("corpus", "doc_id", "h1", "_low")
    copies = blocks.withColumn("_r", F.explode(F.sequence("_low", F.least(F.col("_low") + F.col("_step"), F.col("m")) - 1)))
    before = F.repeat(F.right("text", F.lit(k)), F.least(F.col("_r"), F.lit(k)).cast("int"))
    copies = copies.withColumns({"start": F.col("start") + F.col("_r") * F.col("len"), "halo": F.right(F.concat("halo", before), F.lit(k))})
    return once.unionByName(copies.drop("m", "_step", "_low", "_r"))


def located(documents: DataFrame, placed: Placed, k: int) -> DataFrame:
    """corpus, start, halo, text (and strata) of every document, stored: what several counts read."""
    importable(documents.sparkSession)
    names = ["corpus", "start", "halo", "text", *(["strata"] if "strata" in documents.columns else [])]
    return stored(_with_places(documents, k, placed, None).select(*names), "located")


def placed_texts(documents: DataFrame, placed: Placed) -> DataFrame:
    """corpus, start, text of every document."""
    return _with_places(documents, 0, placed, None).select("corpus", "start", "text")


def letters_from(documents: DataFrame, placed: Placed, bounds: DataFrame, at: str) -> DataFrame:
    """corpus, ch, n of the characters from the place in the column ``at`` of ``bounds`` (a row a corpus) on. The
    document at that place is found in the narrow table of places; those behind it are told by their keys alone,
    so texts are neither joined nor stored."""
    ends = placed.table.drop("halo").join(F.broadcast(bounds.select("corpus", F.col(at).alias("at"))), "corpus").where("start <= at AND at < start + m * len")
    ends = stored(ends.select("corpus", *[F.col(c).alias(f"_{c}") for c in KEY[1:]], "m", (F.col("at") - F.col("start")).alias("inside")), "ends")
    rows = documents.join(F.broadcast(ends), "corpus")
    h1, h2, size = F.xxhash64("text"), F.crc32(F.col("text").cast("binary")), F.length("text").cast("long")
    later = (h1 > F.col("_h1")) | ((h1 == F.col("_h1")) & ((h2 > F.col("_h2")) | ((h2 == F.col("_h2")) & (size > F.col("_len")))))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    behind = rows.where(F.coalesce(F.col("doc_id") > F.col("_doc_id"), F.col("doc_id").isNull() & F.col("_doc_id").isNotNull()) | (same & later))
    # Equal rows are one here: its copies behind the place are counted, and the one in which it lies is cut.
    here = rows.where(same & (h1 == F.col("_h1")) & (h2 == F.col("_h2")) & (size == F.col("_len"))).select("corpus", "text", "m", "inside", "_len").distinct()
    rest = F.expr("substring(text, cast(inside % _len as int) + 1)")
    out = counting.letters(behind).unionByName(counting.letters(here.select("corpus", rest.alias("text"))))
    whole = counting.letters(here.select("corpus", "text")).join(F.broadcast(ends), "corpus").select("corpus", "ch", F.expr("n * (m - inside div _len - 1)").alias("n"))
    return out.unionByName(whole).groupBy("corpus", "ch").agg(F.sum("n").alias("n"))


def characters(documents: DataFrame, k: int, wrap: bool = False, window: DataFrame | None = None, placed: Placed | None = None, edges: DataFrame | None = None) -> DataFrame:
    """corpus, pos, ch, ctx (up to ``k`` characters before pos, whatever the split), stratum (null
    unless the documents have strata), seg.

    With a ``window`` (corpus, low, high) pieces outside of it are left out before they are exploded.
    ``edges`` (corpus, lows: first positions of the segments from 0 on, live: which of them are wanted)
    gives each character the number of its segment; pieces without a wanted one are left out.
    """
    whole = _with_places(documents, k, placed or place(documents, k, wrap), window)
    strata = "strata" in documents.columns
    # Pieces with their own halos: the document's halo, or the end of the piece before.
    size = max(PIECE, k)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    whole = whole.select("corpus", "start", "halo", pieces.alias("pieces"), *(["strata"] if strata else []))
    part = lambda i: F.substring("strata", i * size + 1, F.lit(size)) if strata else F.lit(None).cast("string")
    with_left = F.transform("pieces", lambda piece, i: F.struct(F.when(i == 0, F.col("halo")).otherwise(F.right(F.get("pieces", i - 1), F.lit(k))).alias("left"), piece.alias("piece"), part(i).alias("strata")))
    cut = whole.select("corpus", "start", F.posexplode(with_left).alias("i", "p"))
    cut = cut.select("corpus", (F.col("start") + F.col("i") * size).alias("at"), F.length("p.left").alias("h"), F.concat("p.left", "p.piece").alias("s"), F.length("p.piece").alias("size"), "p.strata")
    if window is not None:
        cut = cut.join(F.broadcast(window), "corpus").where((F.col("at") < F.col("high")) & (F.col("at") + F.col("size") > F.col("low"))).drop("low", "high")
    seg, more = F.lit(None).cast("int"), []
    if edges is not None:
        upto = lambda x: F.size(F.filter("lows", lambda e: e <= x)) - 1
        cut = cut.join(F.broadcast(edges), "corpus").withColumns({"first": upto(F.col("at")), "last": upto(F.col("at") + F.col("size") - 1)})
        cut = cut.where(F.exists(F.slice("live", F.col("first") + 1, F.col("last") - F.col("first") + 1), lambda x: x))
        # Most pieces lie in one segment; the others carry the edges within them.
        cut = cut.withColumn("within", F.slice("lows", F.col("first") + 2, F.col("last") - F.col("first")))
        more = ["first", "within"]
    rows = cut.select("corpus", "at", "h", "s", "strata", *more, F.explode(F.sequence(F.lit(1), F.col("size"))).alias("j"))
    j, h = F.col("j"), F.col("h")
    pos = F.col("at") + j - 1
    if edges is not None:
        seg = F.when(F.size("within") == 0, F.col("first")).otherwise(F.col("first") + F.size(F.filter("within", lambda e: e <= pos)))
    ctx = F.substring("s", F.greatest(F.lit(1), h + j - k), F.least(F.lit(k), h + j - 1))
    stratum = F.get(F.array(*map(F.lit, NAMES)), F.ascii(F.substring("strata", j, F.lit(1))) - ord("a")) if strata else F.lit(None).cast("string")
    return rows.select("corpus", pos.alias("pos"), F.substring("s", h + j, F.lit(1)).alias("ch"), ctx.alias("ctx"), stratum.alias("stratum"), seg.alias("seg"))


def split_bounds(sizes: DataFrame, test: str = "last") -> DataFrame:
    """corpus, n, vocab_size, n_tr, t0, t1: train is [0, n_tr), test [t0, t1).

    ``last`` tests on the last tenth, ``ninth`` on the tenth before it, ``rotated`` from the train's
    end for a tenth of the length.
    """
    n = F.col("n").cast("double")
    t0, t1 = {
        "last": (F.col("n_tr") + F.col("n_vl"), F.col("n")),
        "ninth": (F.floor(n * F.lit(0.8)), F.floor(n * F.lit(0.8 + 0.1))),
        "rotated": (F.floor(n * F.lit(0.8)), F.floor(n * F.lit(0.8)) + F.floor(n * F.lit(0.1))),
    }[test]
    return sizes.select("corpus", "n", "vocab_size", "n_tr", t0.cast("long").alias("t0"), t1.cast("long").alias("t1"))
