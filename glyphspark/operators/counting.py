"""Counting characters with their contexts in packed integers, over Arrow batches.

A symbol is the place of a character in its corpus' alphabet, in as few bits as that takes. A key is the
context, nearest symbol first, and then the character, packed from the top of as many 64-bit words as it
needs: contexts that end alike are next to each other in the order of keys, and a key is cut to a lower
order by dropping symbols from its end. Keys are exact; nothing is hashed but the number of a part.

Texts are counted in chunks of ``CHUNK`` characters. Keys travel as packed arrays, one row for a part, by
*levels*: orders 0, 1, 2 to 3, 4 to 8 and the rest, each dealt out by the symbols that all of its orders share. So
every context meets its counts in one task. A task sends the distinct keys of the upper levels by ``HELD`` characters
if they are one word, else chunk by chunk, as other chunks have few of them: as they come if nearly all are distinct.
Those of the lower levels, and all of texts that repeat themselves, it merges until it has ``FLUSH``. So memory is
bounded whatever the text.

Each upper level is sorted once in the second step: cut to any order, equal contexts stay next to each other, and
a second sort with the character first does the same for contexts with their character. What no test shares up to an
order, none shares in those above, so both shrink; of the long keys it is left out before they are sorted. One-word
keys are sorted as plain numbers, with their tag and count in the bits that the rank of their first symbols saves.
Lower levels are cut and merged.

Characters of a segment count for the same parts with the same depth; what is counted apart is a *tag*: the
group of the segment, how many orders are past the cap, and the class if strata make it differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters counted at once, and distinct keys at which a task merges and sends what it has.
CHUNK, FLUSH = 1 << 18, 1 << 20
#: Characters of the corpora for each part of the second step, and parts at most.
PART_CHARS, MAX_PARTS = 4_000_000, 4096
#: Order from which on levels are sorted once, and the share of a chunk's characters below which distinct keys are merged.
LAST, REPEATED = 4, 0.25
#: Order from which on keys are a level of their own, sent as they come if so many of a sample are distinct. A part with
#: so many times its share of a chunk is merged all the same.
LONG, SPARSE, CROWDED = 9, 0.5, 8
#: An odd number that mixes bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits for the count beside a one-word key, at least.
COUNT_BITS = 6
#: Keys of one word that a task holds before it sorts them, longer ones that it holds before it sends them, and rows that
#: are put in order as they are.
HELD, HELD_LONG, SMALL = 12 << 20, 1 << 20, 1 << 12
#: Share of the last level's keys below which those that no test asks for are dropped.
DENSE = 0.7
#: Rows of an Arrow batch of results.
ROWS = 50_000


@dataclass
class Plan:
    """What a worker knows of a corpus."""

    name: str
    points: np.ndarray  #: code points; the symbol of a character is its place in them, from 1 on
    kinds: np.ndarray  #: (strata + 1, symbols + 1): 2 structural, 1 lexical, 0; the first row without a stratum
    lows: np.ndarray  #: first positions of the segments
    group: np.ndarray  #: group of each segment, -1 if it is not wanted
    shift: np.ndarray  #: of each segment: position less this is the place in the first turn's test
    tr: np.ndarray  #: (groups, turns): depth in the train, -1 if not in it
    te: np.ndarray  #: the same for the test
    last: np.ndarray | None = None  #: (orders, symbols + 1): place of the cap

    @property
    def bits(self) -> int:
        return max(1, len(self.points).bit_length())

    def symbols(self) -> np.ndarray:
        lut = np.zeros(int(self.points.max(initial=0)) + 1, np.uint64)
        lut[self.points] = np.arange(1, len(self.points) + 1, dtype=np.uint64)
        return lut


def levels(orders: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Orders that are counted together; the first of each says by how many symbols its contexts are dealt."""
    split = [[k for k in sorted(set(orders)) if low <= k <= high] for low, high in ((0, 0), (1, 1), (2, LAST - 1), (LAST, LONG - 1), (LONG, 1 << 30))]
    return [tuple(ks) for ks in split if ks]


def cut(words: list[np.ndarray], bits: int, high: int, k: int) -> list[np.ndarray]:
    """Keys of order ``high`` as keys of order ``k``."""
    if k == high:
        return words
    each = 64 // bits
    at = lambda p: np.uint64(64 - bits * (p % each + 1))
    ch = (words[high // each] >> at(high)) & np.uint64((1 << bits) - 1)
    kept = (((1 << (bits * (k % each))) - 1) << (64 - bits * (k % each))) if k % each else 0
    return [*words[: k // each], (words[k // each] & np.uint64(kept)) | (ch << at(k))]


def symbol(words: list[np.ndarray], bits: int, p: int) -> np.ndarray:
    """The symbol at a place of the keys: the context from 0 on, the character after it."""
    each = 64 // bits
    return ((words[p // each] >> np.uint64(64 - bits * (p % each + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _starts(arrays: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(arrays[0]), bool)
    new[:1] = True
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def order_of(arrays: list[np.ndarray]) -> np.ndarray:
    """The order of rows of numbers from 0 on, the first array counting most; equal rows keep theirs.

    Words of a share of the bits and the place are sorted from the last bits to the first: sorting plain words
    is several times faster than sorting places by them."""
    n, fields = len(arrays[0]), []
    if n < SMALL:
        return np.lexsort(arrays[::-1])
    for a in arrays:  # only bits that are ever set
        any_ = int(np.bitwise_or.reduce(a))
        if any_:
            low = (any_ & -any_).bit_length() - 1
            fields.append((a, low, any_.bit_length() - low))
    places = np.uint64((n - 1).bit_length())
    each, index, at = 64 - int(places), np.arange(n, dtype=np.uint64), None
    while fields:
        part, filled = None, 0
        while fields and filled < each:
            a, low, width = fields.pop()
            take = min(width, each - filled)
            some = ((a.astype(np.uint64, copy=False) >> np.uint64(low)) & np.uint64((1 << take) - 1)) << np.uint64(filled)
            part = some if part is None else part | some
            filled += take
            if take < width:
                fields.append((a, low + take, width - take))
        part = (part if at is None else part[at]) << places
        part |= index
        part.sort()
        part &= np.uint64((1 << int(places)) - 1)
        found = part.view(np.int64)
        at = found if at is None else at[found]
    return index.view(np.int64) if at is None else at


def distinct(words: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, and their counts."""
    if counts is None and len(words) == 1:
        words = [np.sort(words[0])]
    else:
        at = order_of(words)
        words, counts = [w[at] for w in words], None if counts is None else counts[at]
    first = _starts(words)
    n = np.diff(np.append(first, len(words[0]))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return [w[first] for w in words], n.astype(np.int64)


def merged(words: list[np.ndarray], tags: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys in order, each once for each of its tags."""
    at = order_of(words)
    words, tags, counts = [w[at] for w in words], tags[at], counts[at]
    new = np.zeros(len(tags), np.int64)
    new[_starts(words)] = 1
    by = np.cumsum(new) * (int(tags.max(initial=0)) + 1) + tags
    at = np.argsort(by)
    first = at[starts := _starts([by[at]])]
    return [w[first] for w in words], tags[first], np.add.reduceat(counts[at], starts) if len(at) else counts


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, str, str, str | None]]]]:
    """Corpus and (position, characters before, text, strata) of about ``CHUNK`` characters at a time; longer
    texts are cut."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        names = batch.schema.names
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            strata = part.column("strata").to_pylist() if "strata" in names else [None] * part.num_rows
            for name, start, halo, text, s in zip(*(part.column(c).to_pylist() for c in ("corpus", "start", "halo", "text")), strata, strict=True):
                for i in range(0, len(text), CHUNK):
                    whole = len(text) <= CHUNK
                    piece = text if whole else text[i : i + CHUNK]
                    held.setdefault(name, []).append((start + i, halo if i == 0 else text[max(0, i - 64) : i], piece, s if whole or s is None else s[i : i + CHUNK]))
                    size[name] = size.get(name, 0) + len(piece)
                    if size[name] >= CHUNK:
                        yield name, held.pop(name)
                        size.pop(name)
        # Many corpora do not add up to many chunks.
        while sum(size.values()) > 2 * CHUNK:
            name = max(size, key=size.get)
            yield name, held.pop(name)
            size.pop(name)
    yield from held.items()


class Chunk:
    """Symbols of some texts with the segment of each character, -1 for those that are only context."""

    def __init__(self, plan: Plan, lut: np.ndarray, rows: list[tuple[int, str, str, str | None]]):
        joined = "".join([x for _, halo, text, _ in rows for x in (halo, text)])
        self.sym = lut[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        start, before, size = (np.array(x, np.int64) for x in ([r[0] for r in rows], [len(r[1]) for r in rows], [len(r[2]) for r in rows]))
        self._first = np.searchsorted(plan.lows, start, "right") - 1
        self._last = np.searchsorted(plan.lows, start + size - 1, "right") - 1
        self._each, self._lows, self._start, self._size = np.column_stack([before, size]).ravel(), plan.lows, start, size
        self._ends = np.cumsum(self._each)[1::2]
        self._base, self._runs = start - self._ends + size, before + size
        self.rows = rows

    @property
    def one(self) -> int | None:
        """The segment, if all texts lie in the same."""
        low = int(self._first[0])
        return low if (self._first == low).all() and (self._last == low).all() else None

    def own(self) -> np.ndarray:
        """Which characters are not only context."""
        return np.repeat(np.tile([False, True], len(self.rows)), self._each)

    @cached_property
    def seg(self) -> np.ndarray:
        start, size = self._start, self._size
        out = np.repeat(np.column_stack([np.full(len(start), -1), self._first]).ravel(), self._each)
        for d in np.flatnonzero(self._first != self._last):
            out[self._ends[d] - size[d] : self._ends[d]] = np.searchsorted(self._lows, np.arange(start[d], start[d] + size[d]), "right") - 1
        return out

    def pos(self) -> np.ndarray:
        return np.repeat(self._base, self._runs) + np.arange(len(self.sym))

    def strata(self) -> np.ndarray:
        """Row of ``Plan.kinds`` of each character."""
        if self.rows[0][3] is None:
            return np.zeros(len(self.sym), np.int64)
        shown = "".join([x for _, halo, _, s in self.rows for x in ("`" * len(halo), s)])
        return np.frombuffer(shown.encode(), np.uint8).astype(np.int64) - ord("`")


def keys(sym: np.ndarray, bits: int, high: int) -> list[np.ndarray]:
    """The key of order ``high`` of each character; before the first one there is symbol 0."""
    return _keys(sym, contexts(sym, bits, min(high, 64 // bits)), bits, high)


def contexts(sym: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k`` symbols before each character in one word, nearest first."""
    out, have = np.zeros(len(sym), np.uint64), min(k, 1)
    if have:
        out[1:] = sym[:-1] << np.uint64(64 - bits)
    while have < k:  # those of the place so many symbols before go on behind
        more = out[: max(0, len(out) - have)] >> np.uint64(bits * have)
        out[have:] |= more
        have = min(2 * have, k)
    if k:
        out &= _top(bits * k)
    return out


def _top(n: int) -> np.uint64:
    return np.uint64(((1 << n) - 1) << (64 - n))


def _keys(sym: np.ndarray, ctx: np.ndarray, bits: int, high: int) -> list[np.ndarray]:
    """The same from the contexts of as many symbols as a word takes, or ``high``."""
    each, words = 64 // bits, []
    for w in range(high // each + 1):
        k = min(each, high - w * each)
        word = np.zeros(len(sym), np.uint64)
        word[w * each :] = ctx[: max(0, len(sym) - w * each)]
        if k < each:
            word &= _top(bits * k)
            word |= sym << np.uint64(64 - bits * (k + 1))
        words.append(word)
    return words


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    out = words[0] * MIX
    for w in words[1:]:
        out ^= out >> np.uint64(32)
        out ^= w
        out *= MIX
    return out


def _share_distinct(words: list[np.ndarray]) -> float:
    """The share of distinct keys by those of a sixty-fourth of the hashes."""
    h = _mixed(words)
    some = h[h >> np.uint64(58) == 0]
    return len(np.unique(some)) / len(some) if len(some) else 0.0


def _packed(words: list[np.ndarray], counts: np.ndarray | None, tags: np.ndarray) -> bytes:
    """Words, counts in the fewest bytes (``None``: all 1), tags (one, if they are equal) and a byte that says how."""
    high = 0 if counts is None else int(counts.max())
    size = 0 if high < 1 << 8 else 1 if high < 1 << 16 else 2 if high < 1 << 32 else 3
    one = bool((tags == tags[0]).all())
    parts = [*words, *([] if counts is None else [counts.astype(f"u{1 << size}")]), tags[:1] if one else tags]
    return b"".join([*(x.tobytes() for x in parts), bytes([size + 4 * one + 8 * (counts is None)])])


def _unpacked(words: int, n: int, data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    each, at, size = [np.frombuffer(data, np.uint64, n, 8 * n * w) for w in range(words)], 8 * n * words, data[-1] % 4
    ones = bool(data[-1] & 8)
    counts = np.ones(n, np.int64) if ones else np.frombuffer(data, f"u{1 << size}", n, at).astype(np.int64)
    tags = np.frombuffer(data, np.int32, 1 if data[-1] & 4 else n, at if ones else at + (n << size))
    return each, counts, np.repeat(tags, n) if data[-1] & 4 else tags


class Counter:
    """First step: distinct keys by corpus and tag of a task's texts, those of upper levels apart from the lower ones."""

    def __init__(self, plans: list[Plan], orders: tuple[int, ...], capped: int, parts: int):
        self.plans = {p.name: (i, p, p.symbols()) for i, p in enumerate(plans)}
        self.levels, self.capped, self.parts = levels(orders), capped, parts
        #: Highest orders of the lower levels and of each upper one: tables are kept by these.
        low = max((max(ks) for ks in self.levels if ks[0] < LAST), default=0)
        self.high = [max(ks) if ks[0] >= LAST else low for ks in self.levels]
        self.highs = sorted(set(self.high))
        self.tables: dict[tuple[int, int, int], list] = {}
        self.held, self.ready = 0, []
        #: Keys of one word as they came, and how many there are.
        self.raw: dict[tuple[int, int, int], list[np.ndarray]] = {}
        self.unsorted = 0
        #: Keys of more words, and how many there are.
        self.long: dict[tuple[int, int, int], list[list[np.ndarray]]] = {}
        self.unsent = 0

    def _tags(self, plan: Plan, chunk: Chunk) -> list[tuple[int, np.ndarray]]:
        """Tags of a chunk and where they are: its places, or all that are not only context."""
        whole = chunk.one
        if whole is not None and (plan.group[whole] < 0 or (plan.te[plan.group[whole]] < 0).all()):
            return [] if plan.group[whole] < 0 else [(int(plan.group[whole]) * (self.capped + 1) * 3, chunk.own())]
        group = np.append(plan.group, -1)[chunk.seg]
        live = group >= 0
        if not live.any():
            return []
        tag = group * ((self.capped + 1) * 3)
        test = np.flatnonzero(live & np.append((plan.te >= 0).any(axis=1), False)[group])
        if len(test) and len(plan.kinds) > 1:
            tag[test] += plan.kinds[chunk.strata()[test], chunk.sym[test].astype(np.int64)]
        if len(test) and plan.last is not None:
            off, s = (chunk.pos() - np.append(plan.shift, 0)[chunk.seg])[test], chunk.sym[test].astype(np.int64)
            first = plan.te[group[test], 0] >= 0
            for last in plan.last:
                tag[test] += 3 * ((last[s] < off) & first)
        return [(int(t), np.flatnonzero(live & (tag == t))) for t in np.flatnonzero(np.bincount(tag[live]))]

    def add(self, name: str, rows: list) -> None:
        i, plan, lut = self.plans[name]
        chunk = Chunk(plan, lut, rows)
        tags, bits = self._tags(plan, chunk), plan.bits
        if not tags:
            return
        ctx = contexts(chunk.sym, bits, min(self.highs[-1], 64 // bits))
        for high in self.highs:
            words = _keys(chunk.sym, ctx, bits, high)
            if len(words) == 1:
                if bits * (high + 1) <= 32:  # half the width sorts in half the time
                    words = [(words[0] >> np.uint64(64 - bits * (high + 1))).astype(np.uint32)]
                for t, at in tags:
                    own = words[0][at]
                    self.raw.setdefault((i, t, high), []).append(own)
                    self.unsorted += len(own)
                continue
            for t, at in tags:
                own = [w[at] for w in words]
                self.long.setdefault((i, t, high), []).append(own)
                self.unsent += len(own[0])
        if self.unsent >= HELD_LONG:
            self._send()
        if self.unsorted >= HELD:
            self._sort()

    def _send(self) -> None:
        """Longer keys: those that are mostly distinct as they are, others as distinct ones."""
        plans = list(self.plans.values())
        for i, t, high in list(self.long):
            own, plan, at = [np.concatenate(w) for w in zip(*self.long.pop((i, t, high)), strict=True)], plans[i][1], self.high.index(high)
            if high >= LONG and _share_distinct(own) >= SPARSE:
                self.ready.extend(self._as_they_come(i, plan, t, own, at))
                continue
            found = distinct(own)
            if high >= LAST and len(found[1]) > REPEATED * len(own[0]):
                self.ready.extend(self._rows(i, plan, [(t, found)], high, at))
            else:
                self.tables.setdefault((i, t, high), []).append(found)
                self.held += len(found[1])
        self.unsent = 0

    def _sort(self) -> None:
        """Keys of one word as distinct ones: those of lower levels and of texts that repeat themselves to the tables,
        others to be sent."""
        plans, by = list(self.plans.values()), {}
        for key in list(self.raw):
            each, (i, t, high) = self.raw.pop(key), key
            words, counts = distinct([np.concatenate(each)])
            if words[0].dtype == np.uint32:
                words = [words[0].astype(np.uint64) << np.uint64(64 - plans[i][1].bits * (high + 1))]
            if high >= LAST and len(counts) > REPEATED * sum(map(len, each)):
                by.setdefault((i, high), []).append((t, (words, counts)))
            else:
                self.tables.setdefault(key, []).append((words, counts))
                self.held += len(counts)
        self.unsorted = 0
        for (i, high), mine in by.items():
            self.ready.extend(self._rows(i, plans[i][1], mine, high, self.high.index(high)))

    def merge(self) -> None:
        self._send()
        self._sort()
        self.held = 0
        for key, found in self.tables.items():
            if len(found) > 1:
                found = [distinct([np.concatenate(w) for w in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found]))]
                self.tables[key] = found
            self.held += len(found[0][1])

    def sent(self) -> Iterator[dict]:
        """Rows that need not wait for others."""
        rows, self.ready = self.ready, []
        yield from rows

    def emit(self) -> Iterator[dict]:
        """Rows of part, corpus, level, n and the packed keys, tags and counts; the tables are empty then."""
        self._send()
        self._sort()
        yield from self.sent()
        plans = list(self.plans.values())
        for i, high in sorted({(i, high) for i, _, high in self.tables}):
            mine = [(t, found) for (j, t, h), each in self.tables.items() if (j, h) == (i, high) for found in each]
            for at, own in enumerate(self.high):
                if own == high:
                    yield from self._rows(i, plans[i][1], mine, high, at)
        self.tables, self.held = {}, 0

    def _rows(self, i: int, plan: Plan, mine: list, high: int, at: int) -> Iterator[dict]:
        bits, orders = plan.bits, self.levels[at]
        if orders[-1] < high:
            mine = [(t, distinct(cut(w, bits, high, orders[-1]), n)) for t, (w, n) in mine]
        words = [np.concatenate(w) for w in zip(*(f[0] for _, f in mine), strict=True)]
        counts = np.concatenate([f[1] for _, f in mine])
        tags = np.repeat(np.array([t for t, _ in mine], np.int32), [len(f[1]) for _, f in mine])
        ends = self._ends(plan, words, at)
        runs = _starts([ends])  # keys are in order
        part, size = self._part(i, at, ends[runs]), np.diff(np.append(runs, len(ends)))
        by = np.argsort(part, kind="stable")
        part, size, runs = part[by], size[by], runs[by]
        upto = np.cumsum(size)
        by = np.repeat(runs - upto + size, size) + np.arange(len(counts))
        words, counts, tags = [w[by] for w in words], counts[by], tags[by]
        first = _starts([part])
        for r, a, b in zip(first.tolist(), (upto - size)[first].tolist(), [*(upto - size)[first[1:]].tolist(), len(counts)], strict=True):
            yield {"part": int(part[r]), "corpus": i, "level": at, "n": b - a, "data": _packed([w[a:b] for w in words], counts[a:b], tags[a:b])}

    def _ends(self, plan: Plan, words: list[np.ndarray], at: int) -> np.ndarray:
        """The symbols that all orders of a level share, as far as they are in one word."""
        shared = min(self.levels[at][0], 64 // plan.bits)
        return words[0] >> np.uint64(64 - plan.bits * shared) if shared else np.zeros(len(words[0]), np.uint64)

    def _part(self, i: int, at: int, ends: np.ndarray) -> np.ndarray:
        mixed = ends + np.uint64((i * 8 + at) * 0x9E3779B1 + 1)
        mixed *= MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX
        mixed >>= np.uint64(32)
        mixed *= np.uint64(self.parts)
        return (mixed >> np.uint64(32)).astype(np.uint16)

    def _as_they_come(self, i: int, plan: Plan, tag: int, words: list[np.ndarray], at: int) -> Iterator[dict]:
        """Rows of keys in no order, of which most are distinct; a part that gets far more than its share has equal ones."""
        part = self._part(i, at, self._ends(plan, words, at))
        by = np.argsort(part, kind="stable")
        words, size, b = [w[by] for w in words], np.bincount(part), 0
        for p in np.flatnonzero(size).tolist():
            a, b = b, b + int(size[p])
            mine, counts = [w[a:b] for w in words], None
            if b - a > CROWDED * (1 + len(by) // self.parts):
                mine, counts = distinct(mine)
            yield {"part": p, "corpus": i, "level": at, "n": len(mine[0]), "data": _packed(mine, counts, np.array([tag], np.int32))}


SENT = "part int, corpus int, level int, n long, data binary"


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, bytes_ = [], 0
    for row in rows:
        held.append(row)
        bytes_ += len(row["data"])
        if bytes_ > size or len(held) == 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


class Summed:
    """Second step: the counts of one corpus and level, by order."""

    def __init__(self, plan: Plan, capped: int, orders: tuple[int, ...], ks: tuple[int, ...]):
        self.plan, self.capped, self.orders, self.ks = plan, capped, orders, ks

    def tables(self, words: list[np.ndarray], counts: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], list[dict[str, np.ndarray]]]]:
        """Order, its keys and, for each turn: c, t, a, n, s, x of the keys."""
        plan, bits, high = self.plan, self.plan.bits, self.orders[-1]
        deepest = np.maximum(plan.tr.max(axis=1), plan.te.max(axis=1))
        for k in reversed(self.orders):
            # What was merged for the order above is cut again, so tables shrink with the order.
            words, high = cut(words, bits, high, k), k
            words, tags, counts = merged(words, tags, counts)
            kind, past, group = tags % 3, tags // 3 % (self.capped + 1), tags // (3 * (self.capped + 1))
            live = np.flatnonzero(deepest[group] >= k)
            if not len(live):
                continue
            cutted = [w[live] for w in words]
            first = _starts(cutted)
            found = [w[first] for w in cutted]
            ch = symbol(found, bits, k)
            contexts = _starts([*found[:-1], found[-1] ^ (ch.astype(np.uint64) << np.uint64(64 - bits * (k % (64 // bits) + 1)))])
            of = np.repeat(np.arange(len(contexts)), np.diff(np.append(contexts, len(ch))))
            g, n, out = group[live], counts[live], []
            for v in range(plan.tr.shape[1]):
                tested = plan.te[g, v] >= k
                row = {"c": np.add.reduceat(np.where(plan.tr[g, v] >= k, n, 0), first), "a": np.add.reduceat(np.where(tested, n, 0), first)}
                row["t"] = np.add.reduceat(row["c"], contexts)[of]
                if len(plan.kinds) > 1:
                    classed = tested & (kind[live] > 0)
                    row["n"] = np.add.reduceat(np.where(classed, n, 0), first)
                    row["x"] = np.maximum.reduceat(np.where(tested, kind[live], 0), first).astype(np.int64)
                else:
                    of_ch = plan.kinds[0][ch].astype(np.int64)
                    classed = tested
                    row["n"], row["x"] = np.where(of_ch > 0, row["a"], 0), np.where(row["a"] > 0, of_ch, 0)
                if plan.last is None or k not in self.ks:
                    row["s"] = row["n"]
                else:
                    row["s"] = np.where(row["n"] > 0, np.add.reduceat(np.where(classed & (past[live] <= self.ks.index(k)), n, 0), first), 0)
                out.append(row)
            yield k, found, out


def _steps(words: list[np.ndarray]) -> list[np.ndarray]:
    """Each key's bits that differ from those of the key before; all of the first one's do."""
    out = []
    for w in words:
        out.append(np.empty_like(w))
        np.bitwise_xor(w[1:], w[:-1], out=out[-1][1:])
        out[-1][:1] = ~np.uint64(0)
    return out


def _apart(steps: list[np.ndarray], full: int, bits: int) -> np.ndarray:
    """Where the first ``full`` words or the ``bits`` bits after them change."""
    new = None
    for w in steps[:full]:
        new = w != 0 if new is None else new | (w != 0)
    if bits:
        some = steps[full] >= np.uint64(1 << (64 - bits))
        new = some if new is None else new | some
    return np.flatnonzero(new)


def _once(words: list[np.ndarray], counts: np.ndarray, tags: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys in order, each once for each of its tags."""
    at = order_of([*words, tags])
    words, tags, counts = [w[at] for w in words], tags[at], counts[at]
    first = _starts([*words, tags])
    if len(first) == len(tags):
        return words, counts, tags
    return [w[first] for w in words], np.add.reduceat(counts, first), tags[first]


def _asked_for(words: list[np.ndarray], tests: np.ndarray, bits: int, k: int) -> np.ndarray | None:
    """Places of the keys of which a test has the first ``k`` symbols, by a hash of them: some more may be among
    them. ``None``: about all."""
    each = 64 // bits
    first = [*words[: k // each], *([words[k // each] & _top(bits * (k % each))] if k % each else [])]
    bit = max(10, int(tests.sum()).bit_length() + 4)
    at = _mixed(first) >> np.uint64(64 - bit)
    asked = np.zeros(1 << bit, bool)
    asked[at[tests]] = True
    kept = asked[at]
    return np.flatnonzero(kept) if np.count_nonzero(kept) < DENSE * len(kept) else None


class _Side:
    """Keys in order, by context or by character and context, of which some are tests'. ``edge`` is the words
    and the bits after them that the first k symbols take."""

    def __init__(self, words: list[np.ndarray], group: np.ndarray, counts: np.ndarray, edge: Callable[[int], tuple[int, int]], tests: np.ndarray, by: np.ndarray | None = None):
        self.words, self.group, self.counts, self.edge, self.tests, self.by = words, group, counts, edge, tests, by
        self.steps: list[np.ndarray] = []
        self.sums: dict[tuple, np.ndarray] = {}

    def cut(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of order ``k`` begin, with the end, and the run of each test's key. Runs without a test
        are of no use to this order and those above; if they are many, they are dropped."""
        if not self.steps:
            self.steps = _steps(self.words)
            if self.by is not None:
                for w in self.steps:
                    w[1:][self.by[1:] != self.by[:-1]] = ~np.uint64(0)
        first = np.append(_apart(self.steps, *self.edge(k)), len(self.group))
        size = np.diff(first)
        run = np.repeat(np.arange(len(size), dtype=np.int32), size)
        at = run[self.tests]
        asked = np.zeros(len(size), bool)
        asked[at] = True
        if size[asked].sum() >= DENSE * len(self.group):
            return first, at
        kept = asked[run]
        self.tests = (np.cumsum(kept, dtype=np.int32) - 1)[self.tests]
        self.words, self.group, self.counts = [w[kept] for w in self.words], self.group[kept], self.counts[kept]
        self.by = None if self.by is None else self.by[kept]
        self.steps, self.sums = [], {}
        return np.append(0, np.cumsum(size[asked])), (np.cumsum(asked, dtype=np.int32) - 1)[at]

    def upto(self, deep: np.ndarray) -> np.ndarray:
        """Running sums of the keys of some groups."""
        key = tuple(deep.tolist())
        if key not in self.sums:
            out = self.sums[key] = np.zeros(len(self.group) + 1, np.int64)
            np.cumsum(self.counts * deep[self.group], out=out[1:])
        return self.sums[key]


def _tight(plan: Plan, group_of: np.ndarray, tested: np.ndarray, orders: tuple[int, ...], word: np.ndarray, counts: np.ndarray, tags: np.ndarray) -> tuple[_Side, _Side, np.ndarray, np.ndarray, np.ndarray] | None:
    """Both sides of one-word keys and tags, counts and characters of the tests' keys, by plain sorts: the symbols that
    all orders share become a rank, which leaves bits for the tag and the count. ``None``, if those are too few."""
    bits, low, high, n = plan.bits, orders[0], orders[-1], len(word)
    ends = word >> np.uint64(64 - bits * low)
    runs = _starts([ends])
    shared, rank = np.unique(ends[runs], return_inverse=True)
    present = np.flatnonzero(np.bincount(tags))
    p, t = max(1, (len(shared) - 1).bit_length()), (len(present) - 1).bit_length()
    c = 64 - p - bits * (high + 1 - low) - t
    if c < COUNT_BITS:
        return None
    most = min((1 << c) - 1, 1 << 40)
    lut = np.zeros(int(present[-1]) + 1, np.uint64)
    lut[present] = np.arange(len(present), dtype=np.uint64) << np.uint64(c)
    packed = word << np.uint64(bits * low)
    packed >>= np.uint64(p)
    packed |= np.repeat(rank.astype(np.uint64) << np.uint64(64 - p), np.diff(np.append(runs, n)))
    packed |= lut[tags] if len(present) > 1 else np.uint64(0)
    cut, ones = np.uint64(c), np.uint64((1 << c) - 1)

    def parted(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keys with their counts; more than a count's bits hold is several keys."""
        if int(counts.max()) > most:
            times = (counts - 1) // most + 1
            first = np.cumsum(times) - times
            key, left = np.repeat(key, times), counts - most * (times - 1)
            counts = np.full(len(key), most, np.int64)
            counts[first] = left
        return key | counts.view(np.uint64)

    packed = parted(packed, counts)
    packed.sort()
    first = _starts([packed >> cut])
    if len(first) < len(packed):
        counts = np.add.reduceat((packed & ones).view(np.int64), first)
        packed = parted(packed[first] & ~ones, counts)
    tail = np.uint64(t + c)
    # The character goes to the front; tag and count stay behind.
    turned = packed >> (tail + np.uint64(bits))
    turned <<= tail
    turned |= packed & np.uint64((1 << (t + c)) - 1)
    turned |= packed >> tail << np.uint64(64 - bits)
    turned.sort()
    groups, asked, small = group_of[present].astype(np.uint16), tested[present], np.uint64((1 << t) - 1)

    def side(keys: np.ndarray, more: int) -> tuple[_Side, np.ndarray]:
        tag = ((keys >> cut) & small).astype(np.uint16)
        at = np.flatnonzero(asked[tag])
        return _Side([keys], groups[tag], (keys & ones).view(np.int64), lambda k: (0, more + p + bits * (k - low)), at), tag

    (ctx, _), (gram, tag) = side(packed, 0), side(turned, bits)
    # Tests' keys by character and context: in the order of the turned keys, which is stable.
    ch = (packed[ctx.tests] >> tail) & np.uint64((1 << bits) - 1)
    ctx.tests = ctx.tests[np.argsort(ch.astype(np.uint16) if bits <= 16 else ch, kind="stable")]
    return ctx, gram, present[tag[gram.tests]], gram.counts[gram.tests], (turned[gram.tests] >> np.uint64(64 - bits)).astype(np.int64)


def last_level(plan: Plan, capped: int, orders: tuple[int, ...], ks: tuple[int, ...], words: list[np.ndarray], counts: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Order, turn and ch, c, t, a, n, s, x as in ``count``, of one corpus' upper level: keys in any order, any often."""
    bits, high, tr, te, each = plan.bits, orders[-1], plan.tr, plan.te, 3 * (capped + 1)
    tested = np.repeat((te >= orders[0]).any(axis=1), each)  # by tag
    if orders[0] >= LONG:
        kept = _asked_for(words, tested[tags], bits, orders[0])
        if kept is not None:
            words, counts, tags = [w[kept] for w in words], counts[kept], tags[kept]
    if not tested[tags].any():
        return
    present = np.bincount(tags // each, minlength=len(tr)) > 0
    group_of = np.arange(len(tested)) // each
    found = _tight(plan, group_of, tested, orders, words[0], counts, tags) if len(words) == 1 and orders[0] * bits < 64 and len(tr) < 1 << 16 else None
    if found is not None:
        ctx, gram, tag, n_test, ch_test = found
    else:
        words, counts, tags = _once(words, counts, tags)
        group = group_of[tags].astype(np.int32)
        ch = symbol(words, bits, high)
        ch = ch.astype(np.uint16) if bits <= 16 else ch
        by = np.argsort(ch, kind="stable")
        tests = np.flatnonzero(tested[tags[by]])
        tag, n_test, ch_test = (x[by[tests]] for x in (tags, counts, ch))
        ch_test, edge = ch_test.astype(np.int64), lambda k: (k // (64 // bits), bits * (k % (64 // bits)))
        ctx, gram = _Side(words, group, counts, edge, by[tests]), _Side([w[by] for w in words], group[by], counts[by], edge, tests, ch[by])
        del group, ch, by, tests
    del words, counts, tags, found
    group_test, past, kinds = group_of[tag], tag // 3 % (capped + 1), tag % 3
    for k in orders:
        (contexts, context), (grams, run) = ctx.cut(k), gram.cut(k)
        for v in range(tr.shape[1]):
            deep, tested = (tr[:, v] >= k) & present, (te[:, v] >= k)[group_test]
            if not tested.any():
                continue
            own = slice(None) if tested.all() else np.flatnonzero(tested)
            # First the keys of a run, which are next to each other, then runs of equal counts.
            runs, n = run[own], n_test[own]
            first = _starts([runs])
            a, ch_, r, at = np.add.reduceat(n, first), ch_test[own][first], runs[first], context[own][first]
            by_ctx, by_gram = ctx.upto(deep), gram.upto(deep)
            t, c = by_ctx[contexts[at + 1]] - by_ctx[contexts[at]], by_gram[grams[r + 1]] - by_gram[grams[r]]
            if len(plan.kinds) > 1:
                n = np.where(kinds[own] > 0, n, 0)
                classed, x = np.add.reduceat(n, first), np.maximum.reduceat(kinds[own], first).astype(np.int64)
            else:
                x = plan.kinds[0][ch_].astype(np.int64)
                classed = np.where(x > 0, a, 0)
            s = classed
            if plan.last is not None and k in ks:
                s = np.where(classed > 0, np.add.reduceat(np.where(past[own] <= ks.index(k), n, 0), first), 0)
            keyed = [ch_, c, t]
            size = [int(y.max()).bit_length() for y in keyed]
            if sum(size) <= 63:
                keyed = [ch_ << (size[1] + size[2]) | c << size[2] | t]
            at = order_of(keyed)
            start = _starts([y[at] for y in keyed])
            one = at[start]
            yield k, v, [ch_[one], c[one], t[one], *(np.add.reduceat(y[at], start) for y in (a, classed, s)), np.maximum.reduceat(x[at], start)]


def _text(plan: Plan, sym: np.ndarray) -> list[str]:
    """Rows of symbols as strings."""
    shown = plan.points[sym - 1].astype("<u4").tobytes().decode("utf-32-le")
    width = sym.shape[1]
    return [shown[i : i + width] for i in range(0, len(shown), width)] if width else [""] * len(sym)


def count(docs: DataFrame, plans: list[Plan], orders: tuple[int, ...], ks: tuple[int, ...], whole: bool, chars: int, turns: int = 1) -> DataFrame:
    """The tally of ``docs`` (corpus, start, halo, text and, if any, strata).

    ``whole``: corpus, k, ctx, ch and c{v}, t{v}, a{v}, n{v}, s{v}, x{v} of every turn v. Else without contexts:
    corpus, k, v, ch, c, t, a, n, s, x, those with equal c and t added up, where the test has any (or order 0 the train)."""
    capped = len(ks) if any(p.last is not None for p in plans) else 0
    parts = max(1, min(MAX_PARTS, 1 + chars // PART_CHARS))
    sent = _arrow(SENT)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(plans, orders, capped, parts)

        def rows() -> Iterator[dict]:
            for name, held in texts(batches):
                counter.add(name, held)
                yield from counter.sent()
                if counter.held > 3 * FLUSH:
                    counter.merge()
                    if counter.held > FLUSH:
                        yield from counter.emit()
            counter.merge()
            yield from counter.emit()

        yield from _batches(rows(), sent)

    names = [f"{x}{v}" for v in range(turns) for x in "ctansx"]
    schema = "corpus string, k int, ctx string, ch string, " + ", ".join(f"{x} long" for x in names) if whole else "corpus string, k int, v int, ch string, c long, t long, a long, n long, s long, x long"
    arrow, of_level = _arrow(schema), levels(orders)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                plan = plans[row["corpus"]]
                held.setdefault((row["corpus"], row["level"]), []).append(_unpacked(of_level[row["level"]][-1] // (64 // plan.bits) + 1, row["n"], row["data"]))
        for (i, level) in sorted(held):
            plan, found = plans[i], held.pop((i, level))
            words = [np.concatenate(w) for w in zip(*(f[0] for f in found), strict=True)]
            counts, tags = (np.concatenate([f[j] for f in found]) for j in (1, 2))
            del found
            if not whole and of_level[level][0] >= LAST:
                for k, v, (ch, *sums) in last_level(plan, capped, of_level[level], ks, words, counts, tags):
                    yield from rows_of(plan, k, v, ch, sums)
                continue
            for k, keyed, each in Summed(plan, capped, of_level[level], ks).tables(words, counts, tags):
                yield from (rows_whole if whole else rows_summed)(plan, k, keyed, each)

    def rows_whole(plan: Plan, k: int, keyed: list[np.ndarray], each: list[dict]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keyed[0]), ROWS):
            some = [w[a : a + ROWS] for w in keyed]
            sym = np.column_stack([symbol(some, plan.bits, p) for p in [*reversed(range(k)), k]])
            cols = [[plan.name] * len(sym), [k] * len(sym), _text(plan, sym[:, :-1]), _text(plan, sym[:, -1:])]
            cols += [each[v][x][a : a + ROWS] for v in range(turns) for x in "ctansx"]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def rows_summed(plan: Plan, k: int, keyed: list[np.ndarray], each: list[dict]) -> Iterator[pa.RecordBatch]:
        ch = symbol(keyed, plan.bits, k)
        for v, row in enumerate(each):
            kept = np.flatnonzero((row["a"] > 0) | ((row["c"] > 0) if k == 0 else False))
            if not len(kept):
                continue
            by = [ch[kept], row["c"][kept], row["t"][kept]]
            at = order_of(by)
            by, kept = [b[at] for b in by], kept[at]
            start = _starts(by)
            sums = [*(b[start] for b in by[1:]), *(np.add.reduceat(row[x][kept], start) for x in "ans"), np.maximum.reduceat(row["x"][kept], start)]
            yield from rows_of(plan, k, v, by[0][start], sums)

    def rows_of(plan: Plan, k: int, v: int, ch: np.ndarray, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = pa.array(_text(plan, np.arange(1, len(plan.points) + 1)[:, None]))
        for a in range(0, len(ch), ROWS):
            each = ch[a : a + ROWS]
            cols = [pa.repeat(plan.name, len(each)), np.full(len(each), k, np.int32), np.full(len(each), v, np.int32), names.take(pa.array(each - 1)), *(x[a : a + ROWS] for x in sums)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql import functions as F

    return docs.mapInArrow(first, SENT).repartitionById(parts, F.col("part")).mapInArrow(second, schema)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points of UTF-8 bytes and how often they come."""
    n = np.bincount(data, minlength=256)
    low = np.flatnonzero(n[:128])
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return low, n[low]
    more = np.append(data, np.zeros(3, np.uint8))
    b0, b1, b2, b3 = (more[lead + i].astype(np.int64) for i in range(4))
    two, three = (b0 & 31) << 6 | b1 & 63, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63
    high, m = np.unique(np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)), return_counts=True)
    return np.append(low, high), np.append(n[low], m)


def letters(docs: DataFrame) -> DataFrame:
    """corpus, ch, n of ``docs`` (corpus, text), one row for each part of the table that has the character."""
    schema = "corpus string, ch string, n long"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            names = batch.column("corpus")
            each = names.unique().to_pylist()
            for name in each:
                text = (batch if len(each) == 1 else batch.filter(pc.equal(names, name))).column("text").cast(pa.large_string())
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
                for low in range(int(ends[0]), int(ends[-1]), CHUNK):  # pieces end where a character does
                    a, b = (x + int(np.argmax(np.append(data[x : min(x + 4, ends[-1])] & 0xC0, 0) != 0x80)) for x in (low, min(low + CHUNK, int(ends[-1]))))
                    points, n = code_points(data[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(points), pa.string()), pa.array([chr(p) for p in points], pa.string()), pa.array(n, pa.int64())], schema=arrow)

    return docs.select("corpus", "text").mapInArrow(run, schema)


def places(docs: DataFrame, plans: list[Plan], schema: str, wanted: Callable[[Plan, Chunk], dict[str, np.ndarray]]) -> DataFrame:
    """Rows that ``wanted`` makes of the chunks of ``docs``: ``corpus`` and the columns of ``schema``."""
    arrow = _arrow(f"corpus string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {p.name: (p, p.symbols()) for p in plans}
        for name, rows in texts(batches):
            plan, lut = known[name]
            cols = wanted(plan, Chunk(plan, lut, rows))
            n = len(next(iter(cols.values())))
            for a in range(0, n, ROWS):
                some = {"corpus": [name] * min(ROWS, n - a)} | {x: c[a : a + ROWS] for x, c in cols.items()}
                yield pa.RecordBatch.from_arrays([pa.array(some[f.name], f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, f"corpus string, {schema}")
