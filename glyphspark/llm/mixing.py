"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are summed; the weights share all words (times ``share``) among the
sources, no source getting more than ``max_epochs`` times its own; what exceeds that is shared again
by weight. A source's rate is its target over its size: each of its documents is emitted floor(rate)
times, and once more if its hash-seeded draw is below the fraction.

The draw is a hash of the seed, doc_id, text and the row's number among equal ones, so reruns agree and a
source that one repeated row makes up still comes near its target. Equal rows are counted before anything
is shuffled and dealt out again in blocks, so no task gets all of them. In ``mix`` rows are equal if all
their columns are; those that share doc_id and text but differ elsewhere draw alike there.

A null or empty text has size 0; very long texts are counted whole; a null source is a source of its own,
after the others; a source without words gets target 0; ties of sources cannot be, as they are told apart
by name. An empty table gives an empty one. ``mix`` keeps every column of the documents whatever its name;
``mixing_plan`` reads doc_id, text and source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, discard, file_count, stored

#: Sources up to this many are broadcast (their names and five numbers); more are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: Keys of repeated rows up to this many are broadcast (some tens of megabytes).
MAX_BROADCAST_ROWS = 300_000
#: Pieces of a source in the shuffled join, so that one source's documents spread.
_SALTS = 64


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def text_digest(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def draw(seed: int, digest: Column, at: Column | None = None) -> Column:
    """Uniform in [0, 1): the first 52 bits of an MD5 of seed, doc_id, the text's own MD5 and, from the
    second of equal rows on, its number."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)
    if at is not None:
        key = F.when(at > 0, F.concat_ws(":", key, at.cast("string"))).otherwise(key)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _numbered(groups: DataFrame) -> DataFrame:
    """Rows with a count ``_m`` as so many rows with numbers ``_at`` from 0. Groups of many are dealt out
    in about as many blocks as a block has rows."""
    zero = F.lit(0).cast("long")
    once = groups.where("_m = 1").withColumn("_at", zero)
    many = groups.where("_m > 1").withColumn("_step", F.ceil(F.sqrt(F.col("_m").cast("double"))).cast("long"))
    many = many.withColumn("_low", F.explode(F.sequence(zero, F.col("_m") - 1, F.col("_step")))).repartition("doc_id", "_low")
    many = many.withColumn("_at", F.explode(F.sequence("_low", F.least(F.col("_low") + F.col("_step"), F.col("_m")) - 1)))
    return once.unionByName(many.drop("_step", "_low")).drop("_m")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    The limit of sharing the excess again and again has a closed form: in ascending order of
    max_epochs * size / weight the sources that stop are the first ones, and the others get their
    weight times one level. Window functions over the sources, of which there are few.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    upto, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * max_epochs).over(upto), F.lit(0))) / F.sum("weight").over(after)
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("long"))
        .withColumn("ratio", F.col("source_size") * max_epochs / F.col("weight"))
        .withColumn("level", level)
    )
    # The first source, in that order, whose share at its level it can bear ends the ones that stop.
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    return ranked.withColumn("final", final).select(
        "source", "source_size", F.least(F.col("source_size") * F.lit(float(max_epochs)), F.coalesce(F.col("weight") * F.col("final"), F.lit(0.0))).alias("target")
    )


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies: what the mix does with each document."""
    files = file_count(docs)
    rows = docs.select("doc_id", "source", words().alias("size"), text_digest().alias("_digest"))
    groups = stored(rows.groupBy("doc_id", "source", "size", "_digest").agg(F.count(F.lit(1)).alias("_m")), "mix-sizes", files)
    targets = stored(source_targets(groups.select("source", (F.col("size") * F.col("_m")).alias("size")), weights, max_epochs), "mix-targets", 1)
    narrow = _numbered(groups).select("doc_id", "source", "size", draw(seed, F.col("_digest"), F.col("_at")).alias("u"))
    # Null is a source of its own: the join is on a flag and a name that are never null.
    keyed = lambda d: d.withColumns({"_named": F.col("source").isNotNull(), "_name": F.coalesce("source", F.lit(""))})
    left, right, on = keyed(narrow), keyed(targets).drop("source"), ["_named", "_name"]
    if targets.count() <= MAX_BROADCAST_SOURCES:
        right = F.broadcast(right)
    else:
        on = [*on, "_salt"]
        left = left.withColumn("_salt", F.floor(F.col("u") * _SALTS).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate").cast("long")
    return (
        left.join(right, on)
        .withColumn("rate", rate)
        .withColumn("copies", whole + (F.col("u") < F.col("rate") - whole).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as the plan says, columns unchanged.

    The targets of the sources are joined to the rows by source, so texts are not shuffled, but for those
    of rows that occur more than once.
    """
    names, files = docs.columns, file_count(docs)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", text_digest().alias("_digest"))
    rows = docs.select("doc_id", "source", words().alias("size"), text_digest().alias("_digest"))
    groups = rows.groupBy("doc_id", "source", "size", "_digest").agg(F.count(F.lit(1)).alias("_m"))
    # One pass for both: what sources hold, and which rows may be equal.
    groups = stored(groups, "mix-groups", files)
    targets = stored(source_targets(groups.select("source", (F.col("size") * F.col("_m")).alias("size")), weights, max_epochs), "mix-targets", 1)
    twice = stored(groups.where("_m > 1").select("doc_id", "_digest").distinct(), "mix-twice", files)
    discard(groups)
    n_twice = twice.count()
    inner = inner.withColumn("_at", F.lit(0).cast("long"))
    if n_twice:
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._digest") == F.col("b._digest"))
        keys = (F.broadcast(twice) if n_twice <= MAX_BROADCAST_ROWS else twice).alias("b")
        equal = inner.drop("_at").alias("a").join(keys, same, "left_semi").groupBy("_row", "doc_id", "source", "_digest").agg(F.count(F.lit(1)).alias("_m"))
        inner = inner.alias("a").join(keys, same, "left_anti").unionByName(_numbered(equal))
    rates = targets.select(
        F.col("source").isNotNull().alias("_named"),
        F.coalesce("source", F.lit("")).alias("_name"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    )
    on = ["_named", "_name"]
    inner = inner.select("_row", draw(seed, F.col("_digest"), F.col("_at")).alias("_u"), F.col("source").isNotNull().alias("_named"), F.coalesce("source", F.lit("")).alias("_name"))
    if targets.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    else:
        on = [*on, "_salt"]
        inner = inner.withColumn("_salt", F.floor(F.col("_u") * _SALTS).cast("int"))
        rates = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    whole = F.floor("_rate").cast("int")
    copies = whole + (F.col("_u") < F.col("_rate") - whole).cast("int")
    return inner.join(rates, on).select(F.explode(F.array_repeat("_row", copies)).alias("_row")).select("_row.*")
