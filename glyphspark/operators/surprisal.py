"""Counts, coverage and capped surprisal of characters under fixed-order n-gram models.

The text is cut into segments in which every character counts for the same parts (train or test, of one
split or of several rotations) with the same number of characters before it. ``counting`` counts distinct
contexts in two steps and adds up, for each order, character and turn, the occurrences in the test that have
the same counts in the train. What is stored is these sums: gains, coverage and frequencies are plain sums
over them, whatever the smoothing. Rotations are further columns, not further passes. Contexts themselves are
made only for those who ask (``ngrams``, ``tally``).

The mean of a character's surprisal takes its first ``cap`` occurrences by position. The cap is a place
in the text, found by counting: occurrences by character and cell of positions (cells grow with the
position, so there are some thousands at most), running sums over a character's cells, and a look into
the one cell in which the cap falls, cut again as long as it holds more than ``CELL_ROWS`` occurrences.
So no window holds all occurrences of a character, and what is broadcast is bounded by Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.strata import NAMES
from . import chars, counting

#: Cells of positions per doubling of the position.
CELLS = 64
#: Occurrences of a cell that may be put in order in one group; a fuller cell is cut in ``CUTS`` first.
CELL_ROWS, CUTS = 1 << 20, 1024


@dataclass(frozen=True)
class Setup:
    """What the generations of the analysis differ in."""

    ks: tuple[int, ...] = tuple(range(1, 9))
    classifier: Callable[..., Column] = field(default=classify.nl)
    alpha: float = 1.0
    cap: int | None = 5000
    test: str = "last"
    #: Only occurrences that have this many characters before them in the test, for every order.
    least_context: int | None = None
    #: Tenths of the corpus by which it is turned before it is split.
    rotation: int = 0
    #: Several turns at once (without a cap): the tables get a column ``split`` then.
    rotations: tuple[int, ...] | None = None

    @property
    def turns(self) -> tuple[int, ...]:
        return (self.rotation,) if self.rotations is None else self.rotations


def _tested(plan: counting.Plan, chunk: counting.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Places in the first turn's test and symbols of a chunk's classified characters of that test."""
    group = np.append(plan.group, -1)[chunk.seg]
    at = np.flatnonzero((group >= 0) & (np.append(plan.te[:, 0], -1)[group] >= 0))
    sym = chunk.sym[at].astype(np.int64)
    kept = plan.kinds[chunk.strata()[at], sym] > 0
    return (chunk.pos() - np.append(plan.shift, 0)[chunk.seg])[at][kept], sym[kept]


class Corpus:
    """Documents prepared once: places, sizes and the tally are stored when first asked for.

    ``trim`` is what to leave out at the corpus' end: the separator, if texts are joined by it."""

    def __init__(self, documents: DataFrame, setup: Setup, trim: str = ""):
        if setup.rotations is not None and setup.cap is not None:
            raise ValueError("several rotations have no cap")
        chars.importable(documents.sparkSession)
        self.documents, self.setup, self.k, self.trim = chars.spread(documents), setup, max(setup.ks), trim
        self.strata = "strata" in documents.columns
        self.by = ["corpus"] if setup.rotations is None else ["corpus", "split"]

    @cached_property
    def placed(self) -> chars.Placed:
        return chars.place(self.documents, self.k, any(self.setup.turns), len(self.trim))

    @cached_property
    def letters(self) -> DataFrame:
        """corpus, ch, n of the whole corpus."""
        rows = chars.letters(self.documents)
        for ch in self.trim:
            rows = rows.withColumn("n", F.col("n") - (F.col("ch") == ch).cast("long"))
        return chars.stored(rows.where("n > 0"), "corpus-letters")

    @cached_property
    def sizes(self) -> DataFrame:
        return chars.stored(chars.stats(self.letters), "corpus-sizes")

    @cached_property
    def bounds(self) -> DataFrame:
        return chars.split_bounds(self.sizes, self.setup.test)

    @cached_property
    def _segments(self) -> list[tuple]:
        """corpus, seg, low, tr, te, shift: the depth (characters before it in the part, up to ``k``) of
        the segment's characters in train and test of each turn, -1 if they are not in it; a position
        less ``shift`` is its place in the first turn's test. Some dozens for each corpus."""
        least, out = self.setup.least_context or 0, []
        deep = max(self.k, least)
        for b in self.bounds.collect():
            offsets = [int(b.n * turn / 5.0 / 2.0) for turn in self.setup.turns]
            starts = [*range(deep + 1), b.n_tr, *range(b.t0, b.t0 + deep + 1), b.t1]
            lows = sorted({0, *((at + off) % b.n for off in offsets for at in starts if at <= b.n)})
            for seg, low in enumerate(lows):
                places = [(low - off) % b.n for off in offsets]
                tr = [min(at, deep) if at < b.n_tr else -1 for at in places]
                te = [min(at - b.t0, deep) if b.t0 <= at < b.t1 and at >= b.n_tr and at - b.t0 >= least else -1 for at in places]
                out.append((b.corpus, seg, low, tr, te, low - (places[0] - b.t0)))
            out.append((b.corpus, len(lows), b.n, [-1] * len(offsets), [-1] * len(offsets), 0))  # what is trimmed
        return out

    @cached_property
    def located(self) -> DataFrame:
        return chars.located(self.documents, self.placed, self.k)

    def placed_texts(self) -> DataFrame:
        """corpus, start, text of every document: located ones, if they are there, else not stored for one reader."""
        return self.located.select("corpus", "start", "text") if "located" in self.__dict__ else chars.placed_texts(self.documents, self.placed)

    @cached_property
    def _alphabets(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Code points and classes (see ``counting.Plan``) of each corpus. Unicode bounds them."""
        strata = [None, *NAMES] if self.strata else [None]
        kind = lambda s: self.setup.classifier(F.col("ch"), F.lit(s).cast("string"))
        coded = [F.when(kind(s) == "structural", 2).when(kind(s) == "lexical", 1).otherwise(0) for s in strata]
        found: dict[str, list] = {}
        for r in self.letters.select("corpus", "ch", F.array(*coded).alias("kinds")).toLocalIterator():
            found.setdefault(r.corpus, []).append((ord(r.ch), r.kinds))
        out = {}
        for name, rows in found.items():
            rows.sort()
            kinds = np.zeros((len(strata), len(rows) + 1), np.uint8)
            kinds[:, 1:] = np.array([k for _, k in rows], np.uint8).T
            out[name] = (np.array([p for p, _ in rows], np.int64), kinds)
        return out

    def plans(self, part: str = "both", last: dict[str, np.ndarray] | None = None) -> list[counting.Plan]:
        """What workers need to count the wanted parts."""
        live = {"both": lambda s: max(s[3] + s[4]) >= 0, "train": lambda s: max(s[3]) >= 0, "test": lambda s: max(s[4]) >= 0}[part]
        by: dict[str, list] = {}
        for s in self._segments:
            by.setdefault(s[0], []).append(s)
        out, none = [], (0,) * len(self.setup.turns)
        for name, (points, kinds) in self._alphabets.items():
            segments = sorted(by.get(name, []), key=lambda s: s[1])
            groups = {x: i for i, x in enumerate(sorted({(tuple(s[3]), tuple(s[4])) for s in segments if live(s)}))}
            depth = np.array(list(groups) or [(none, none)], np.int64)
            out.append(counting.Plan(
                name, points, kinds, np.array([s[2] for s in segments], np.int64), np.array([groups[tuple(s[3]), tuple(s[4])] if live(s) else -1 for s in segments], np.int64),
                np.array([s[5] for s in segments], np.int64), depth[:, 0], depth[:, 1], None if last is None else last[name],
            ))
        return out

    @cached_property
    def _n(self) -> int:
        return self.bounds.agg(F.sum("n")).first()[0] or 0

    def _in_test(self) -> DataFrame:
        """Located documents that may reach into the first turn's test."""
        if self.setup.turns[0]:
            return self.located
        bounds = self.bounds.select("corpus", "t0", "t1")
        return self.located.join(F.broadcast(bounds), "corpus").where("start < t1 AND start + length(text) > t0").drop("t0", "t1")

    def test_rows(self, spans: dict[tuple[str, int], tuple[int, int]] | None = None) -> DataFrame:
        """corpus, off (place in the first turn's test), ch (its symbol, see ``counting.Plan``) of the
        classified characters of that test; with ``spans`` only those between two places of their character."""

        def wanted(plan: counting.Plan, chunk: counting.Chunk) -> dict[str, np.ndarray]:
            off, sym = _tested(plan, chunk)
            if spans is not None:
                of = np.array([spans.get((plan.name, i), (1, 0)) for i in range(len(plan.points) + 1)], np.int64)
                kept = (off >= of[sym, 0]) & (off <= of[sym, 1])
                off, sym = off[kept], sym[kept]
            return {"off": off, "ch": sym.astype(np.int32)}

        return counting.places(self._in_test(), self.plans("test"), "off long, ch int", wanted)

    def test_cells(self) -> DataFrame:
        """corpus, ch, cell, n, lo, hi: how often each cell of positions has a character of ``test_rows``, from
        where to where."""

        def wanted(plan: counting.Plan, chunk: counting.Chunk) -> dict[str, np.ndarray]:
            off, sym = _tested(plan, chunk)
            by = np.floor(np.log2(off + 1.0) * CELLS).astype(np.int64) << 32 | sym
            at = np.argsort(by, kind="stable")
            by, off = by[at], off[at]
            first = counting._starts([by])
            if not len(first):
                return {x: by for x in ("ch", "cell", "n", "lo", "hi")}
            n = np.diff(np.append(first, len(by)))
            return {"ch": (by[first] & 0xFFFFFFFF).astype(np.int32), "cell": by[first] >> 32, "n": n, "lo": np.minimum.reduceat(off, first), "hi": np.maximum.reduceat(off, first)}

        rows = counting.places(self._in_test(), self.plans("test"), "ch int, cell long, n long, lo long, hi long", wanted)
        return rows.groupBy("corpus", "ch", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def whole_test(self, wanted: str) -> DataFrame:
        """corpus, ch, stratum, n of the ``wanted`` characters in the first turn's test, its first characters
        included."""
        of, names = {b.corpus: (int(b.n * self.setup.turns[0] / 5.0 / 2.0), b.n, b.t0, b.t1) for b in self.bounds.collect()}, [None, *NAMES]

        def counted(plan: counting.Plan, chunk: counting.Chunk) -> dict[str, list]:
            offset, n, t0, t1 = of[plan.name]
            at = (chunk.pos() - offset) % n
            own = (chunk.seg >= 0) & (at >= t0) & (at < t1)
            kept = own & np.isin(chunk.sym, np.flatnonzero(np.isin(plan.points, [ord(c) for c in wanted])) + 1)
            pairs, m = np.unique(chunk.strata()[kept] << 32 | chunk.sym[kept].astype(np.int64), return_counts=True)
            return {"ch": [chr(plan.points[(p & 0xFFFFFFFF) - 1]) for p in pairs.tolist()], "stratum": [names[p >> 32] for p in pairs.tolist()], "n": m}

        rows = counting.places(self._in_test(), self.plans(), "ch string, stratum string, n long", counted)
        return rows.groupBy("corpus", "ch", "stratum").agg(F.sum("n").alias("n"))

    def cutoffs(self, cell_rows: int = CELL_ROWS) -> DataFrame:
        """corpus, ch, last: for each order, the place in the test of the cap-th occurrence (far off, if
        there are fewer)."""
        measures = [F.count(F.lit(1)).alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi")]
        cells = chars.stored(self.test_cells(), "cells")
        before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy("corpus", "ch", *by).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The cap-th occurrence at or after place k is the (cap + those before k)-th of all. Places below
        # the largest order have a cell each, so cells count those before k.
        if self.k >= CELLS:
            raise ValueError("orders must be below the number of cells of a doubling")
        early = F.array(*[F.sum(F.when(F.col("lo") < k, F.col("n")).otherwise(0)) for k in self.setup.ks])
        ranks = cells.groupBy("corpus", "ch").agg(early.alias("early")).select("corpus", "ch", F.posexplode("early").alias("i", "early"))
        ranks = ranks.select("corpus", "ch", "i", (F.lit(self.setup.cap) + F.col("early")).alias("rank"))
        inside = lambda c: (F.col("rank") > F.col(c)) & (F.col("rank") <= F.col(c) + F.col("n"))
        hits = cells.withColumn("before", before()).join(ranks, ["corpus", "ch"]).where(inside("before"))
        hits = chars.stored(hits.select("corpus", "ch", "i", "lo", "hi", "n", (F.col("rank") - F.col("before")).alias("rank")), "cells-hit")

        def within(h: DataFrame) -> DataFrame:
            spans = {(r.corpus, r.ch): (r.lo, r.hi) for r in h.groupBy("corpus", "ch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # a row a character
            return self.test_rows(spans).join(F.broadcast(h.select("corpus", "ch", "lo", "hi").distinct()), ["corpus", "ch"]).where("off BETWEEN lo AND hi")

        while (hits.agg(F.max(F.when(F.col("hi") > F.col("lo"), F.col("n")))).first()[0] or 0) > cell_rows:
            part = F.floor((F.col("off") - F.col("lo")) * F.lit(CUTS).cast("decimal(20,0)") / (F.col("hi") - F.col("lo") + 1)).cast("int")
            finer = within(hits).select("corpus", "ch", F.col("lo").alias("of"), "off", part.alias("part"))
            finer = chars.stored(finer.groupBy("corpus", "ch", "of", "part").agg(*measures), "cells")
            asked = hits.select("corpus", "ch", "i", F.col("lo").alias("of"), "rank")
            hits = finer.withColumn("before", before("of")).join(asked, ["corpus", "ch", "of"]).where(inside("before"))
            hits = chars.stored(hits.select("corpus", "ch", "i", "lo", "hi", "n", (F.col("rank") - F.col("before")).alias("rank")), "cells-hit")
        at = Window.partitionBy("corpus", "ch", "lo").orderBy("off")  # cell_rows occurrences at most
        places = within(hits).withColumn("rank", F.row_number().over(at)).join(F.broadcast(hits.drop("hi", "n")), ["corpus", "ch", "lo", "rank"])
        found = places.groupBy("corpus", "ch").agg(F.map_from_entries(F.collect_list(F.struct("i", "off"))).alias("at"))
        far = F.lit(1 << 62).cast("long")
        found = found.join(F.broadcast(self._symbols()), ["corpus", "ch"]).withColumn("ch", F.col("char"))
        return found.select("corpus", "ch", F.array(*[F.coalesce(F.try_element_at("at", F.lit(i)), far) for i in range(len(self.setup.ks))]).alias("last"))

    def _symbols(self) -> DataFrame:
        """corpus, ch (symbol), char. Unicode bounds it."""
        rows = [(name, i + 1, chr(p)) for name, (points, _) in self._alphabets.items() for i, p in enumerate(points.tolist())]
        names, symbols, shown = zip(*rows, strict=True) if rows else ((), (), ())
        table = pa.table({"corpus": pa.array(names, pa.string()), "ch": pa.array(symbols, pa.int32()), "char": pa.array(shown, pa.string())})
        return self.documents.sparkSession.createDataFrame(table)  # without Python workers

    @cached_property
    def _last(self) -> dict[str, np.ndarray] | None:
        """Places of the cap by corpus, order and symbol."""
        if self.setup.cap is None:
            return None
        out = {name: np.full((len(self.setup.ks), len(points) + 1), 1 << 62, np.int64) for name, (points, _) in self._alphabets.items()}
        for r in self.cutoffs().collect():  # a row a character
            out[r.corpus][:, int(np.searchsorted(self._alphabets[r.corpus][0], ord(r.ch))) + 1] = r.last
        return out

    def _count(self, orders: tuple[int, ...], whole: bool, part: str = "both", cap: bool = True) -> DataFrame:
        plans = self.plans(part, self._last if cap else None)
        return counting.count(self.located, plans, orders, self.setup.ks, whole, self._n, len(self.setup.turns))

    @cached_property
    def sums(self) -> DataFrame:
        """corpus, k (0: no context), v (turn), ch, c (in the train), t (of the context) and, added up over the
        contexts of equal c and t: a (in the test), n (classified there), s (those within the cap), x (1 if
        lexical, 2 if structural anywhere in the test)."""
        return chars.stored(self._count((0, *self.setup.ks), False), "corpus-sums")

    @cached_property
    def tally(self) -> DataFrame:
        """corpus, k, ctx, ch and, for each turn v, c{v}, t{v}, a{v}, n{v}, s{v}, x{v} as in ``sums``."""
        return chars.stored(self._count((0, *self.setup.ks), True), "corpus-tally")

    @property
    def counted(self) -> bool:
        """Whether the sums are there already."""
        return "sums" in self.__dict__

    def ngrams(self, k: int | None = None) -> DataFrame:
        """corpus, k, ctx, ch, c of the (first turn's) train part, of one order or of all."""
        if k is not None and k > self.k:
            raise ValueError("the corpus is placed for its own orders")
        rows = self._count(self.setup.ks if k is None else (k,), True, "train", False)
        return rows.where("c0 > 0").select("corpus", "k", "ctx", "ch", F.col("c0").alias("c"))

    def totals(self, k: int | None = None) -> DataFrame:
        """corpus, k, ctx, total."""
        return self.ngrams(k).groupBy("corpus", "k", "ctx").agg(F.sum("c").alias("total"))

    def _turned(self, rows: DataFrame) -> DataFrame:
        """``split`` for the number of the turn, if there are several."""
        turn = F.get(F.array(*map(F.lit, self.setup.turns)), F.col("v"))
        return rows.withColumn("split", turn) if self.setup.rotations is not None else rows

    def surprisal(self, alpha: float | None = None) -> DataFrame:
        """corpus, k, ch, type, sum_surp, sum_sq, n_sum, n, ctx_hit of classified characters. A character
        that strata make structural here and lexical there is structural."""
        a = F.lit(float(self.setup.alpha if alpha is None else alpha))
        rows = self.sums.where("k > 0 AND n > 0").join(F.broadcast(self.sizes.select("corpus", "vocab_size")), "corpus")  # a row for each corpus
        s = -F.log2((F.col("c") + a) / (F.col("t") + a * F.col("vocab_size")))
        hit = F.sum(F.when(F.col("t") > 0, F.col("n")).otherwise(0)).alias("ctx_hit")
        out = rows.groupBy("corpus", "v", "k", "ch").agg(
            F.max("x").alias("kind"), F.sum(F.col("s") * s).alias("sum_surp"), F.sum(F.col("s") * s * s).alias("sum_sq"), F.sum("s").alias("n_sum"), F.sum("n").alias("n"), hit
        )
        kind = F.when(F.col("kind") == 2, "structural").otherwise("lexical").alias("type")
        return self._turned(out).select(*self.by, "k", "ch", kind, "sum_surp", "sum_sq", "n_sum", "n", "ctx_hit")

    def coverage(self, classified: bool = False) -> DataFrame:
        """corpus, k, hits, total, coverage over all test characters, or over the classified ones alone."""
        n = F.col("n" if classified else "a")
        rows = self.sums.where("k > 0").groupBy("corpus", "v", "k").agg(F.sum(F.when(F.col("t") > 0, n).otherwise(0)).alias("hits"), F.sum(n).alias("total"))
        return self._turned(rows.where("total > 0")).select(*self.by, "k", "hits", "total", (F.col("hits") / F.col("total")).alias("coverage"))

    def frequencies(self, part: str = "train") -> DataFrame:
        """corpus, ch, freq in a part."""
        if part == "train" and not (self.counted or self.trim or any(self.setup.turns) or self.setup.rotations):
            # The whole less what comes after the train, a fifth of it.
            later = chars.letters_from(self.documents, self.placed, self.bounds, "n_tr").withColumnRenamed("n", "later")
            found = self.letters.join(F.broadcast(later), ["corpus", "ch"], "left")
            return found.select("corpus", "ch", (F.col("n") - F.coalesce("later", F.lit(0))).alias("freq")).where("freq > 0")
        rows = self.sums.where("k = 0") if self.counted else self._count((0,), False, "both", False)
        found = rows.groupBy("corpus", "v", "ch").agg(F.sum("c" if part == "train" else "a").alias("freq")).where("freq > 0")
        return self._turned(found).select(*self.by, "ch", "freq")
