"""The last level of orders is sorted once, its keys are sent in few bytes; cells of the cap are counted, not exploded."""

import random

import numpy as np
import pytest

from glyphspark.functions import strata
from glyphspark.operators import chars, counting
from glyphspark.operators.surprisal import Corpus, Setup

ORDERS = (0, 2, 4, 5, 9, 15)


def _sent(letters: str, strata: bool) -> tuple[counting.Plan, counting.Counter, list[dict]]:
    rng = random.Random(3)
    text = "".join(rng.choice(letters) for _ in range(4000))
    points = np.array(sorted(map(ord, set(text))), np.int64)
    kinds = np.random.default_rng(1).integers(0, 3, (10 if strata else 1, len(points) + 1)).astype(np.uint8)
    # Two turns; the second segment is shallow, the fourth in the test of one turn and the train of the other.
    depth = np.array([[[15, 15], [-1, -1]], [[4, 7], [-1, -1]], [[-1, 15], [15, -1]], [[-1, -1], [5, 12]], [[-1, -1], [15, 15]]])
    last = None if strata else np.full((len(ORDERS) - 1, len(points) + 1), 40)
    plan = counting.Plan("c", points, kinds, np.array([0, 1500, 1520, 3000, 3020]), np.arange(5), np.array([0, 0, 1520, 3000, 3020]), depth[:, 0], depth[:, 1], last)
    counter, out = counting.Counter([plan], ORDERS, 0 if strata else len(ORDERS) - 1, 3), []
    shown = "".join(rng.choice("abcdefghi") for _ in text) if strata else None
    for i in range(0, 4000, 500):
        counter.add("c", [(i, text[max(0, i - 15) : i], text[i : i + 500], shown and shown[i : i + 500])])
        out += counter.sent()
    return plan, counter, out + list(counter.emit())


@pytest.mark.parametrize("letters", ["ab, ", "".join(map(chr, range(97, 97 + 300)))])
@pytest.mark.parametrize("strata", [False, True])
def test_one_sort_gives_what_cutting_to_each_order_gives(letters, strata):
    plan, counter, sent = _sent(letters, strata)
    level, ks = len(counter.levels) - 1, ORDERS[1:]
    orders, got, want = counter.levels[level], {}, {}
    width = orders[-1] // (64 // plan.bits) + 1
    assert (width > 1) == (len(letters) > 4)
    for part in range(3):
        found = [counting._unpacked(width, r["n"], r["data"]) for r in sent if r["level"] == level and r["part"] == part]
        if not found:
            continue
        rows = [np.concatenate(w) for w in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        for k, v, cols in counting.last_level(plan, counter.capped, orders, ks, *rows):
            for ch, c, t, *sums in zip(*(x.tolist() for x in cols), strict=True):
                assert (part, k, v, ch, c, t) not in got
                got[part, k, v, ch, c, t] = sums
        for k, keyed, each in counting.Summed(plan, counter.capped, orders, ks).tables(*rows):
            ch = counting.symbol(keyed, plan.bits, k).tolist()
            for v, row in enumerate(each):
                for x, c, t, *sums in zip(ch, *(row[y].tolist() for y in "ctansx"), strict=True):
                    if sums[0]:
                        old = want.get((part, k, v, x, c, t), [0, 0, 0, 0])
                        want[part, k, v, x, c, t] = [*(p + q for p, q in zip(old[:3], sums[:3], strict=True)), max(old[3], sums[3])]
    assert got == want and {k for _, k, *_ in got} == set(orders)


def test_a_key_travels_in_few_bytes():
    _, counter, sent = _sent("abcdefghijklmnopqrstuvwxyz", False)
    last = [r for r in sent if r["level"] == len(counter.levels) - 1]
    n = sum(r["n"] for r in last)
    assert sum(len(r["data"]) for r in last) < 20 * n  # two words of eight bytes
    assert sum(r["n"] for r in last) > 3000


def test_repeating_chunks_are_merged():
    plan = counting.Plan("c", np.array([97, 98]), np.ones((1, 3), np.uint8), np.array([0]), np.array([0]), np.array([0]), np.array([[8]]), np.array([[-1]]))
    counter = counting.Counter([plan], (8,), 0, 1)
    for i in range(20):
        counter.add("c", [(i * 1000, "ab" * 4, "ab" * 500, None)])
    assert not counter.ready
    counter.merge()
    assert [(r["n"], counting._unpacked(1, r["n"], r["data"])[1].tolist()) for r in counter.emit()] == [(2, [10000, 10000])]


def test_cells_of_the_cap_are_counted_in_workers(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("ab, é") for _ in range(200))) for i in range(40)]
    c = Corpus(chars.corpus(spark.createDataFrame(docs, "doc_id long, text string")), Setup(ks=(1, 2), cap=7))
    cells, rows = c.test_cells().collect(), c.test_rows().collect()
    assert sum(r.n for r in cells) == len(rows) and len(cells) < len(rows)
    for cell in cells:
        at = [r.off for r in rows if r.ch == cell.ch and cell.lo <= r.off <= cell.hi]
        assert (len(at), min(at), max(at)) == (cell.n, cell.lo, cell.hi)
    spans = {(r.corpus, r.ch): (3, 90) for r in rows}
    assert sorted(c.test_rows(spans).collect()) == sorted(r for r in rows if 3 <= r.off <= 90)


def test_strata_are_counted_without_a_column_of_them(spark):
    code = ["x = 'a' # é🙂\n", "if y:\n    pass\n", "it's no code", "`a` // b\n/* c */ 'd"]
    rows = spark.createDataFrame(list(enumerate(code)), "doc_id long, text string")
    for language in ("python", "javascript"):
        docs = chars.corpus(rows, language=language)
        got = strata.counted_strata(docs, language)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in strata.counted_strata(docs).collect()}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_keys_of_one_word_are_merged_over_chunks():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    points = np.arange(97, 105)
    plan = counting.Plan("c", points, np.ones((1, 9), np.uint8), np.array([0]), np.array([0]), np.array([0]), np.array([[8]]), np.array([[-1]]))
    counter = counting.Counter([plan], (8,), 0, 1)
    for i in range(6):
        counter.add("c", [(i * 3000, "", text, None)])
    assert not list(counter.sent())  # they wait for other chunks
    counter.merge()
    rows = list(counter.emit())
    n = sum(r["n"] for r in rows)
    counts = np.concatenate([counting._unpacked(1, r["n"], r["data"])[1] for r in rows])
    assert n < 3100 and counts.sum() == 18000 and counts.max() >= 6


@pytest.mark.parametrize("n", [0, 1, counting.SMALL - 1, counting.SMALL, 70_000])
def test_order_of_words_is_lexsort(n):
    rng = np.random.default_rng(n)
    wide, narrow = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1), rng.integers(0, 7, n)
    for arrays in ([wide], [narrow, narrow[::-1]], [wide % np.uint64(9) << np.uint64(55), wide, narrow.astype(np.int32)], [np.zeros(n, np.int64)]):
        assert (counting.order_of(arrays) == np.lexsort(arrays[::-1])).all()
