"""Near-duplicate lines: an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct words. A line goes if some earlier line (by doc_id, then line number),
of any document and kept or not, has a Jaccard similarity of at least ``NUM / DEN`` with it. Lines
without words neither match nor go.

* Words of all lines are counted in ``RARITY_BUCKETS`` hashed buckets. The tokens of all lines are ordered
  by the size class of their bucket, then by hash: rarest first, one order for all lines. The join is exact in
  any order; a worse one only makes it dearer.
* Lines of the same token set, by 128 bits of hash, are one class from here on; its first line stands for
  it.
* Of two similar classes, the one with more tokens holds in its probing prefix (the length that its
  smallest possible partner asks for) a token of the indexed prefix of the other (the shorter length that
  partners of its own size or more ask for). So each class is indexed by few tokens, and probes with more.
  Classes that meet are compared if the positional, length and bitmap filters let them pass (the bitmap
  holds the parity of the tokens in each of 128 hashed places, or 64 for short lines, so it differs in no
  more places than the sets do).
* Classes that pass are compared on their words, exactly.

A match with one earlier line is enough, so each class is first compared with the earliest few of about its
length that share one of its ``LED`` rarest tokens. Only classes which that does not settle look for further
partners. So a group of near copies costs about its size, not its square.

Tokens are known by 56 bits of hash until lines are compared. Two words of one line that share them (about
one line in 10^13 of 50 words) may cost that line a match; two lines of equal token hashes but different
words are taken for one class, which asks for such a pair of words in the same place of otherwise equal
lines.

Null and empty texts have no lines with words. Rows of a null doc_id take no part and stay as they
are. Repeated rows of a doc_id are one document here: they share places, so none is earlier than the
other, and they lose the same lines. Very long lines are lines like others. Ties in similarity do not
matter, since any match removes. An empty table gives an empty one. ``dedup_lines`` passes all columns on,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, file_count, stored

#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Counters of the rarity order: a quarter of a megabyte, whatever the corpus.
RARITY_BUCKETS = 1 << 18
#: One line in so many, by a hash of its text, is counted for that order: all of them. Any order gives the same
#: matches.
RARITY_SHARE = 1
#: Rare tokens by which a line looks for one earlier line first.
LED = 8
#: So many of the earliest lines are tried, the first that passes the filters is compared.
EARLY = 3
#: Tokens up to which 64 places of the bitmap are enough.
SHORT = 96
#: A place is doc_id * 2**LINE_BITS + line number.
LINE_BITS = 31
#: Wanted lines are broadcast to the scan up to so many (tens of megabytes); more are joined by shuffle.
MAX_BROADCAST_LINES = 2_000_000
#: What parts words.
BLANKS = " \t\n\v\f\r"


def line_words(line: str | Column) -> Column:
    """Words of a line in order, as an array."""
    c = F.col(line) if isinstance(line, str) else line
    spaced = c
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    other = reduce(or_, [F.contains(c, F.lit(blank)) for blank in BLANKS[1:]])  # a search for one byte is cheaper than a replacement
    return F.array_remove(F.split(F.when(other, spaced).otherwise(c), " "), "")


def _place(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with an id, and the type in which places fit."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    fits = low is None or (-(1 << 31) <= low and high < (1 << 31))
    return known, "long" if fits else "decimal(38,0)"


def _rarity(known: DataFrame) -> Column:
    """Size class of each bucket's word count: a constant array of ``RARITY_BUCKETS`` bytes."""
    lines = known.select(F.explode(F.split("text", "\n")).alias("line"))
    if RARITY_SHARE > 1:  # seeded otherwise than the words, so a line of one word does not fall by its word's bucket
        lines = lines.where(F.pmod(F.xxhash64(F.lit(1), "line"), F.lit(RARITY_SHARE)) == 0)
    words = lines.select(F.explode(line_words("line")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(RARITY_BUCKETS - 1).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    classed = counts.select(F.col("id").cast("int"), F.least(F.floor(F.log2(F.col("n") + 1.0) * 3), F.lit(127)).cast("tinyint").alias("c"))
    packed = classed.agg(F.collect_list("id"), F.collect_list("c")).first()  # one entry a bucket at most
    classes = [0] * RARITY_BUCKETS
    for at, c in zip(*packed, strict=True):
        classes[at] = c
    return F.from_json(F.lit(f"[{','.join(map(str, classes))}]"), "array<tinyint>")


def _keys(line: str, rarity: Column) -> Column:
    """Sorted token keys: size class in the high byte, then 56 bits of hash."""

    def key(h: Column) -> Column:
        place = h.bitwiseAND(RARITY_BUCKETS - 1).cast("int")
        return F.shiftleft(F.coalesce(F.get(rarity, place), F.lit(0).cast("tinyint")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.transform(line_words(line), lambda w: F.xxhash64(w))  # each word is hashed once
    return F.sort_array(F.array_distinct(F.transform(hashes, key)))


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _least_overlap(n: Column, m: Column) -> Column:
    return _ceil_div(NUM * (n + m), NUM + DEN)


def _probing(n: Column) -> Column:
    """Tokens by which a class of ``n`` looks for partners that have no more."""
    return n - _ceil_div(NUM * n, DEN) + 1


def _indexed(n: Column) -> Column:
    """Tokens by which a class of ``n`` is found by partners that have as many or more."""
    return n - _least_overlap(n, n) + 1


def _bitmap() -> list[Column]:
    """low, high: parity of the tokens (keys) in 64 hashed places, and for lines of more than ``SHORT`` tokens
    that of every other token (by one more bit), so that ``low ^ high`` and ``high`` are 128 places."""

    def parity(of: Callable[[Column], Column]) -> Column:
        return F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", of(k), k.bitwiseAND(63).cast("int"))))

    one = parity(lambda k: F.lit(1).cast("long"))
    half = parity(lambda k: F.shiftright(k, 6).bitwiseAND(1))
    return [one.alias("low"), F.when(F.col("n") <= SHORT, F.lit(0).cast("long")).otherwise(half).alias("high")]


def _alike(x: dict[str, Column], y: dict[str, Column], need: Column) -> Column:
    """Whether the bitmaps differ in no more places than the sets of a match can."""
    low, high = x["low"].bitwiseXOR(y["low"]), x["high"].bitwiseXOR(y["high"])
    both = (x["n"] > SHORT) & (y["n"] > SHORT)
    return F.when(both, F.bit_count(low.bitwiseXOR(high)) + F.bit_count(high)).otherwise(F.bit_count(low)) <= x["n"] + y["n"] - 2 * need


def _verified(known: DataFrame, pairs: DataFrame, kind: str, files: int) -> DataFrame:
    """x of those pairs (x, y) of places whose lines have the least similarity or more."""
    wanted = pairs.select(F.col("x").alias("pos")).unionByName(pairs.select(F.col("y").alias("pos"))).distinct()
    shift = F.lit(1 << LINE_BITS).cast(kind)
    doc, line = F.floor(F.col("pos") / shift) if kind != "long" else F.shiftright("pos", LINE_BITS), F.pmod("pos", shift)
    by_doc = stored(wanted.groupBy(doc.cast("long").alias("doc_id")).agg(F.collect_list(line.cast("int")).alias("at")), "lines-wanted", files)
    size = by_doc.agg(F.sum(F.size("at"))).first()[0] or 0
    texts = known.join(F.broadcast(by_doc) if size <= MAX_BROADCAST_LINES else by_doc, "doc_id")
    lines = texts.withColumn("_lines", F.split("text", "\n")).select("doc_id", F.explode("at").alias("i"), "_lines")
    lines = stored(lines.select((F.col("doc_id").cast(kind) * shift + F.col("i")).cast(kind).alias("pos"), F.get("_lines", F.col("i")).alias("line")), "lines-text", files)
    # Lines travel as text, which is a third of their words as an array.
    full = pairs.select("x", "y").join(lines.select(F.col("pos").alias("x"), F.col("line").alias("xl")), "x")
    full = full.join(lines.select(F.col("pos").alias("y"), F.col("line").alias("yl")), "y")
    full = full.select("x", F.array_distinct(line_words("xl")).alias("xs"), F.array_distinct(line_words("yl")).alias("ys"))
    common = F.size(F.array_intersect("xs", "ys"))
    found = stored(full.where((NUM + DEN) * common >= NUM * (F.size("xs") + F.size("ys"))).select("x").distinct(), "lines-settled", files)
    discard(lines, by_doc)
    return found


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, removed: the numbers (from 0) of the lines that go, for documents that lose any."""
    known, kind = _place(docs)
    files = file_count(docs)
    rarity = _rarity(known)
    place = (F.col("doc_id").cast(kind) * F.lit(1 << LINE_BITS).cast(kind) + F.col("i")).cast(kind)
    lines = known.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.ltrim("line", F.lit(BLANKS)) != "")
    lines = lines.select(place.alias("pos"), _keys("line", rarity).alias("keys")).withColumn("n", F.size("keys"))

    prefix = F.slice("keys", 1, _probing(F.col("n")))
    row = lines.select("pos", "n", F.xxhash64("keys").alias("h"), F.xxhash64(F.lit(1), "keys").alias("g"), *_bitmap(), prefix.alias("prefix"))
    table = stored(row, "lines", files)

    # The first line of each class stands for it.
    in_class = Window.partitionBy("h", "g").orderBy("pos")
    classes = stored(table.withColumn("_at", F.row_number().over(in_class)).where("_at = 1").drop("_at"), "lines-classes", files)
    names = stored(table.select("h", "g", "pos"), "lines-names", files)
    discard(table)

    # First each class meets the earliest ones of about its length that share one of its ``LED`` rarest tokens.
    about = F.floor(F.log(F.col("n").cast("double")) * 4.5)  # a column of its own: one window, one shuffle
    keys = classes.select("pos", "n", "low", "high", about.alias("about"), F.explode(F.slice("prefix", 1, LED)).alias("token"))
    keys = keys.select("pos", "n", "low", "high", F.xxhash64("token", "about").alias("at"))
    group = Window.partitionBy("at").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # by rows, the nth is found once
    keys = keys.select("*", *[F.nth_value(F.struct("pos", "n", "low", "high"), r).over(group).alias(f"e{r}") for r in range(1, EARLY + 1)])
    sides = lambda at: {c: F.col(at + c) for c in ("pos", "n", "low", "high")}
    near = lambda x, y: (DEN * y["n"] >= NUM * x["n"]) & (DEN * x["n"] >= NUM * y["n"]) & _alike(x, y, _least_overlap(x["n"], y["n"]))
    likely = [F.when((F.col(f"e{r}.pos") < F.col("pos")) & near(sides(""), sides(f"e{r}.")), F.col(f"e{r}.pos")) for r in range(1, EARLY + 1)]
    met = stored(keys.select(F.col("pos").alias("x"), F.coalesce(*likely).alias("y")).where("y IS NOT NULL").distinct(), "lines-met", files)
    settled = _verified(known, met, kind, files)

    # Then the classes that this has not settled meet all others in the index. Of a pair the larger one
    # probes, of equal ones the later; what is looked for is a match of the later one.
    done = settled.select(F.col("x").alias("pos"), F.lit(True).alias("done"))
    first = classes.join(F.broadcast(done) if done.count() <= MAX_BROADCAST_LINES else done, "pos", "left")
    discard(met)  # and the shuffle of the first pass with it
    # A settled class is coded by a negative number of tokens.
    size = F.when(F.col("done"), -F.col("n")).otherwise(F.col("n")).alias("n")
    side = lambda tokens: first.select("pos", size, "low", "high", F.posexplode(tokens).alias("j", "token"))
    probes, index = side(F.col("prefix")).alias("x"), side(F.slice("prefix", 1, _indexed(F.col("n")))).alias("y")
    x, y = ({c: F.abs(f"{a}.n") if c == "n" else F.col(f"{a}.{c}") for c in ("pos", "n", "j", "low", "high")} for a in "xy")
    need, later = _least_overlap(x["n"], y["n"]), x["pos"] > y["pos"]
    fits = (
        ((x["n"] > y["n"]) | ((x["n"] == y["n"]) & later))
        & (DEN * y["n"] >= NUM * x["n"])
        & F.when(later, F.col("x.n") > 0).otherwise(F.col("y.n") > 0)
        & (1 + F.least(x["n"] - x["j"] - 1, y["n"] - y["j"] - 1) >= need)
        & _alike(x, y, need)
    )
    pairs = probes.join(index, (F.col("x.token") == F.col("y.token")) & fits)
    pairs = stored(pairs.select(F.greatest("x.pos", "y.pos").alias("x"), F.least("x.pos", "y.pos").alias("y")).distinct(), "lines-pairs", files)
    late = _verified(known, pairs, kind, files)

    # A line goes if it is not the first of its class, or if its class is settled.
    match = settled.unionByName(late).select(F.col("x").alias("_first"), F.lit(True).alias("_match")).distinct()
    firsts = classes.select("h", "g", F.col("pos").alias("_first")).join(match, "_first", "left")
    gone = names.join(firsts, ["h", "g"]).where((F.col("pos") > F.col("_first")) | F.col("_match"))
    shift = F.lit(1 << LINE_BITS).cast(kind)
    doc = F.shiftright("pos", LINE_BITS) if kind == "long" else F.floor(F.col("pos") / shift)
    numbers = gone.select(doc.cast("long").alias("doc_id"), F.pmod("pos", shift).cast("int").alias("i"))
    out = stored(numbers.groupBy("doc_id").agg(F.sort_array(F.collect_set("i")).alias("removed")), "lines-removed", files)
    discard(classes, names, settled, pairs, late)
    return out


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed of every row."""
    narrow = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    full = narrow.join(removed_lines(docs), "doc_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return full.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with their text without the lines that go; columns and their order unchanged."""
    names = docs.columns
    gone = removed_lines(docs)
    size = gone.agg(F.sum(F.size("removed"))).first()[0] or 0
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_id"))
    full = row.join((F.broadcast(gone) if size <= MAX_BROADCAST_LINES else gone).withColumnRenamed("doc_id", "_id"), "_id", "left")
    left = F.array_join(F.filter(F.split(F.col("_row")["text"], "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_row")["text"]).otherwise(left)
    return full.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names])
