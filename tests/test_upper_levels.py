"""Upper levels of orders: long keys are sent as they come, those that no test asks for are not sorted, and one-word
keys are sorted as plain numbers."""

import random

import numpy as np
import pytest

from glyphspark.operators import counting


def _plan(letters: str, k: int, capped: int) -> counting.Plan:
    points = np.array(sorted(map(ord, letters)), np.int64)
    kinds = np.random.default_rng(1).integers(0, 3, (1, len(points) + 1)).astype(np.uint8)
    depth = np.array([[[k], [-1]], [[-1], [k]]])
    return counting.Plan("c", points, kinds, np.array([0, 3000]), np.arange(2), np.array([0, 3000]), depth[:, 0], depth[:, 1], np.full((capped, len(points) + 1), 90))


def test_long_orders_are_a_level_whose_distinct_keys_travel_without_counts(monkeypatch):
    monkeypatch.setattr(counting, "HELD_LONG", 500)
    rng = random.Random(2)
    plan = _plan("abcdefghijklmnopqrstuvwxyz", 15, 2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)) + "z" * 900
    counter, rows = counting.Counter([plan], (4, 8, 15), 2, 50), []
    for i in range(0, 2900, 500):
        counter.add("c", [(i, text[max(0, i - 15) : i], text[i : min(i + 500, 2900)], None)])
        rows += counter.sent()
    rows += counter.emit()
    assert counter.levels == [(4, 8), (15,)]
    long = [(r, counting._unpacked(2, r["n"], r["data"])) for r in rows if r["level"] == 1]
    assert sum(int(c.sum()) for _, (_, c, _) in long) == 2900
    assert any(len(r["data"]) == 16 * r["n"] + 5 for r, _ in long)  # two words, one tag and how it is packed
    assert max(int(c.max()) for _, (_, c, _) in long) > 300  # equal keys of a crowded part are one


@pytest.mark.parametrize("most", [1, 700_000])
def test_plain_sorts_give_what_sorting_places_gives(monkeypatch, most):
    rng, k = np.random.default_rng(most), 8
    plan, orders = _plan("abcdefgh" + "".join(map(chr, range(0x4E00, 0x4E00 + 80))), k, 3), (4, 5, 8)
    sym = rng.integers(1, 6, 6000).astype(np.uint64)
    words = counting.keys(sym, plan.bits, k)
    counts, tags = rng.integers(1, most + 1, 6000), (rng.integers(0, 10, 6000) > 7) * 12 + rng.integers(0, 4, 6000) * 3
    tags = np.where(tags < 12, 0, tags).astype(np.int32)

    def summed() -> dict:
        return {(o, v, *key): sums for o, v, cols in counting.last_level(plan, 3, orders, orders, words, counts, tags) for *key, a, n, s, x in zip(*(c.tolist() for c in cols), strict=True) for sums in [(a, n, s, x)]}

    tight, took = counting._tight, []
    monkeypatch.setattr(counting, "_tight", lambda *args: took.append(tight(*args)) or took[-1])
    got = summed()
    assert took[0] is not None
    monkeypatch.setattr(counting, "_tight", lambda *args: None)
    assert got and got == summed()
    assert sum(a for (o, *_), (a, *_) in got.items() if o == 8) == counts[tags >= 12].sum()


def test_keys_that_no_test_asks_for_are_left_out():
    rng = np.random.default_rng(3)
    words = counting.keys(rng.integers(1, 27, 9000).astype(np.uint64), 5, 15)
    tests = np.zeros(9000, bool)
    tests[:50] = True
    for w in words:
        w[100:120] = w[:20]
    kept = counting._asked_for(words, tests, 5, 9)
    assert set(range(50)) | set(range(100, 120)) <= set(kept.tolist()) and len(kept) < 1500
    assert counting._asked_for(words, np.ones(9000, bool), 5, 9) is None
