"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the radius (2,081 for radius 4); two fingerprints
within the radius share a variant, and two that share one are within it. So the fingerprints of a
variant form a star around their smallest one, and no pairs within a group need be listed.

Variants are shuffled by their leading bits. A row for each variant would be 12 times the input, so a
fingerprint travels once to each prefix that some variant of it has: the prefixes that differ from its own
in no more bits than half the radius (37 of 256, for 8 bits), packed as 8 bytes. The task of a prefix makes
the variants that begin with it, in leaves of bounded size by further bits; over all prefixes each variant
of each fingerprint is made exactly once. Equal variants are found by sorting, each pair of star centre and
member is verified, and a spanning forest of the links is kept. Components come from ``components``.

* The number of prefixes follows the number of fingerprints, so a prefix has about as many at any size, and
  what is sent grows with n times the square of its logarithm.
* Fingerprints that crowd on some prefixes (large groups of near copies) are counted first: a prefix with
  more than ``HEAVY`` is split by its next bits, again and again. In the end a prefix is one variant, which
  2,081 different fingerprints can have at most.

Documents of equal fingerprints are one node. Texts without words (null, empty, blanks) have
fingerprint zero and link like others. Very long texts are read whole, in slices of shingles. Rows of one
doc_id are rows like any other; a null doc_id takes part but names no component unless it is alone. Of
equal smallest ids ``keep_one`` takes the text of the smallest hash, of equal rows any. An empty table
gives an empty one. Only doc_id and the text column are read; ``keep_one`` passes all columns on, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, file_count, map_arrow, stored, utf8
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Keys of dropped rows are broadcast up to so many (some tens of megabytes); more are joined by shuffle.
MAX_BROADCAST_KEYS = 500_000
#: Fingerprints that a prefix should have, as sent, and those beyond which it is split; variants of a leaf.
CROWD, HEAVY, LEAF = 250_000, 2_000_000, 1 << 20
#: Fingerprints of a task that sends them and of a message, at most; bits by which a heavy prefix is split.
SENT, MESSAGE, MORE_BITS = 1 << 15, 128, 12


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # bytes: lowers A-Z and splits at the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes) - 1
    starts = (stops + 1 - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, stops[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (tells rows of one doc_id apart), fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(raw, shingle) for raw in batch.column("raw").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(fps.view(np.int64))}

    return map_arrow(docs.select("doc_id", _text_hash(text), utf8(text).alias("raw")), "doc_id long, text_hash long, fp long", run)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")


def masks(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits of which at most ``most`` are set, fewest first."""
    found, last = [np.zeros(1, np.uint64)], np.zeros(1, np.uint64)
    for _ in range(min(most, bits)):
        lowest = np.where(last == 0, np.uint64(bits), np.bitwise_count((last & (~last + np.uint64(1))) - np.uint64(1)))
        # Each mask with one more bit below its lowest.
        last = np.concatenate([m | (np.uint64(1) << np.arange(int(low), dtype=np.uint64)) for m, low in zip(last, lowest)])
        found.append(last)
    return np.concatenate(found)


def _prefix(fps: np.ndarray, bits: int) -> np.ndarray:
    return fps >> np.uint64(64 - bits) if bits else np.zeros(len(fps), np.uint64)


def _next(fps: np.ndarray, done: int, bits: int) -> np.ndarray:
    """The ``bits`` bits after the first ``done``."""
    return _prefix(fps, done + bits) & np.uint64((1 << bits) - 1)


def _to(prefix: np.ndarray, fps: np.ndarray, done: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of ``done + bits`` bits, under the given ones of ``done`` bits, that variants of the
    fingerprints have, and the fingerprints, one entry for each."""
    left = half - np.bitwise_count(_prefix(fps, done) ^ prefix).astype(np.int64)
    parts: tuple[list, list] = ([], [])
    for budget in range(half + 1):
        at = np.flatnonzero(left == budget)
        if len(at):
            flips = masks(bits, budget)
            own = (prefix[at] << np.uint64(bits)) | _next(fps[at], done, bits)
            parts[0].append((own[:, None] ^ flips[None, :]).ravel())
            parts[1].append(np.repeat(fps[at], len(flips)))
    if not parts[0]:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(parts[0]), np.concatenate(parts[1])


def _leaves(fps: np.ndarray, prefix: int, bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants that begin with the prefix, and their fingerprints' numbers, in leaves of about ``LEAF``."""
    left = half - np.bitwise_count(_prefix(fps, bits) ^ np.uint64(prefix)).astype(np.int64)
    flips = {budget: masks(64 - bits, budget) for budget in range(half + 1)}
    sizes = np.array([len(flips[b]) for b in range(half + 1)])
    total = int(sizes[left].sum())
    if total > LEAF and bits < 64:
        more = min(64 - bits, 12, max(1, math.ceil(math.log2(total / LEAF))))
        own = _next(fps, bits, more)
        for q in range(1 << more):
            at = np.flatnonzero(np.bitwise_count(own ^ np.uint64(q)) <= left)
            if len(at) > 1:
                for v, owner in _leaves(fps[at], (prefix << more) | q, bits + more, half):
                    yield v, at[owner]
        return
    rest = np.uint64((1 << (64 - bits)) - 1)
    base = np.uint64(prefix << (64 - bits) if bits else 0)
    variants, owners = [], []
    for budget in range(half + 1):
        at = np.flatnonzero(left == budget)
        if len(at):
            variants.append(((fps[at] & rest | base)[:, None] ^ flips[budget][None, :]).ravel())
            owners.append(np.repeat(at, len(flips[budget])))
    if variants:
        yield np.concatenate(variants), np.concatenate(owners)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links a-b."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def meeting(fps: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[list[int], list[int]]:
    """Links (u, v) that connect the fingerprints as far as they share variants of this prefix."""
    fps, found = np.unique(fps), []
    signed = fps.view(np.int64)
    for v, owner in _leaves(fps, prefix, bits, radius // 2):
        ordered = np.sort(v)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = np.flatnonzero(twice[at] == v)
        group, who = at[hit], signed[owner[hit]]
        order = np.lexsort((who, group))
        group, who = group[order], who[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        centre = who[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pairs = np.unique(np.stack([centre, who])[:, ~first], axis=1)
        near = np.bitwise_count(pairs[0].view(np.uint64) ^ pairs[1].view(np.uint64)) <= radius  # always so: two halves meet
        found.append(pairs[:, near])
    if not found:
        return [], []
    return _forest(*np.unique(np.concatenate(found, axis=1), axis=1))


def links(distinct: DataFrame, n: int, radius: int = RADIUS, crowd: int = CROWD, heavy: int = HEAVY) -> DataFrame:
    """Links u, v that connect all of the ``n`` distinct fingerprints (fp) within ``radius`` bits."""
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even: members of a variant are within twice the half radius")
    first = 4
    while first < 32 and n * len(masks(first, half)) >> first > crowd:
        first += 1
    first = max(first, min(8, n.bit_length()))
    spark = distinct.sparkSession
    dealt = distinct.repartition(1 + n // SENT, "fp")  # a number of its own: a small file would be one task
    # Prefixes to split, by their number of bits: those that more fingerprints are sent to than a task should have.
    split: list[tuple[int, int, np.ndarray]] = []

    def entries(fps: np.ndarray, levels: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """bits, prefixes and fingerprints of all entries, those of split prefixes in their parts; the last
        level of ``levels`` comes last."""
        prefix, fps = _to(np.zeros(len(fps), np.uint64), fps, 0, first, half)
        bits = first
        for done, more, crowded in levels:
            inside = crowded[np.minimum(np.searchsorted(crowded, prefix), len(crowded) - 1)] == prefix
            yield done, prefix[~inside], fps[~inside]
            prefix, fps = _to(prefix[inside], fps[inside], done, more, half)
            bits = done + more
        yield bits, prefix, fps

    def counting(batches):
        for batch in batches:
            *_, (bits, prefix, _) = entries(batch.column(0).to_numpy().view(np.uint64), shared.value)
            names, counts = np.unique(prefix, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64))], ["prefix", "n"])

    def send(batches):
        for batch in batches:
            out: dict[str, list] = {"bits": [], "prefix": [], "fps": []}
            for bits, prefix, fps in entries(batch.column(0).to_numpy().view(np.uint64), shared.value):
                order = np.argsort(prefix, kind="stable")
                names, starts = np.unique(prefix[order], return_index=True)
                data = fps[order].tobytes()
                for name, start, end in zip(names.view(np.int64).tolist(), starts.tolist(), [*starts[1:].tolist(), len(fps)]):
                    for at in range(start, end, MESSAGE):
                        out["bits"].append(bits)
                        out["prefix"].append(name)
                        out["fps"].append(data[8 * at : 8 * min(end, at + MESSAGE)])
            yield pa.RecordBatch.from_arrays([pa.array(out["bits"], pa.int32()), pa.array(out["prefix"], pa.int64()), pa.array(out["fps"], pa.binary())], ["bits", "prefix", "fps"])

    bits = first
    while bits < 64:
        shared = spark.sparkContext.broadcast(split)  # the crowded prefixes: entries over ``heavy`` at most
        full = dealt.mapInArrow(counting, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > heavy)
        crowded = np.sort(np.array([r.prefix for r in full.select("prefix").collect()], np.int64).view(np.uint64))
        if not len(crowded):
            break
        more = min(MORE_BITS, 64 - bits)
        split = [*split, (bits, more, crowded)]
        bits += more
    shared = spark.sparkContext.broadcast(split)

    def meet(batches):
        held: tuple[tuple[int, int] | None, list[bytes]] = (None, [])
        u: list[int] = []
        v: list[int] = []

        def settle(key: tuple[int, int] | None, parts: list[bytes]) -> None:
            if key is not None and sum(map(len, parts)) > 8:  # one fingerprint meets nothing
                a, b = meeting(np.frombuffer(b"".join(parts), np.uint64), int(np.int64(key[1]).view(np.uint64)), key[0], radius)
                u.extend(a)
                v.extend(b)

        def made():
            rows = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u.clear()
            v.clear()
            return rows

        for batch in batches:
            kinds, names = (batch.column(i).to_numpy() for i in range(2))
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), len(names)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s < e:
                    key, parts = (int(kinds[s]), int(names[s])), batch.column(2).slice(s, e - s).to_pylist()
                    if key == held[0]:
                        held[1].extend(parts)
                    else:
                        settle(*held)
                        held = key, parts
                if len(u) > 10_000:
                    yield made()
        settle(*held)
        yield made()

    sent = dealt.mapInArrow(send, "bits int, prefix long, fps binary")
    # Not coalesced: a prefix is a few messages, but millions of variants.
    met = sent.repartition(max(1, min(1 << first, 1 + n // 4096)), "bits", "prefix").sortWithinPartitions("bits", "prefix")
    return met.mapInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    files = file_count(docs)
    narrow = stored(fingerprints(docs, text, shingle), "fingerprints", files)
    return _components_of(narrow, radius, files).coalesce(files).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components_of(narrow: DataFrame, radius: int, files: int) -> DataFrame:
    nodes = stored(narrow.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes", files)
    found = components(links(nodes.select("fp"), nodes.count(), radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Most components are one fingerprint; the minimum needs a shuffle of nodes, not of documents.
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root")
    return narrow.join(by_fp, "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, columns unchanged: that of the smallest doc_id (nulls last), of its
    texts the one of the smallest hash, of equal rows any."""
    files = file_count(docs)
    narrow = stored(fingerprints(docs), "fingerprints", files)
    key = ("doc_id", "text_hash")
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    grouped = stored(_components_of(narrow, radius, files).select(*key, "root"), "fingerprint-groups", files)
    chosen = stored(grouped.withColumn("_at", F.row_number().over(first)).where("_at = 1").select(*key), "fingerprint-chosen", files)
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    discard(narrow)
    dropped = stored(grouped.alias("g").join(chosen.alias("c"), same("g", "c"), "left_anti").select(*key).distinct(), "fingerprint-dropped", files)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", _text_hash("text"))
    gone = F.broadcast(dropped) if dropped.count() <= MAX_BROADCAST_KEYS else dropped
    kept = rows.alias("r").join(gone.alias("d"), same("r", "d"), "left_anti")
    twice = stored(grouped.groupBy(*key).count().where("count > 1").select(*key).alias("t").join(chosen.alias("c"), same("t", "c"), "left_semi"), "fingerprint-twice", files)
    if twice.isEmpty():
        return kept.select("_row.*")
    # Equal rows of a chosen key: one of them stays.
    once = Window.partitionBy(*key).orderBy("text_hash")
    single = kept.alias("k").join(twice.alias("t"), same("k", "t"), "left_semi").select("k.*").withColumn("_at", F.row_number().over(once)).where("_at = 1")
    return kept.alias("k").join(twice.alias("t"), same("k", "t"), "left_anti").select("_row").unionByName(single.select("_row")).select("_row.*")
