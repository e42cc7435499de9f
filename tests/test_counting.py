"""Packed counting: wide alphabets, long orders, small memory; strata as letters; lines from texts."""

import random
from collections import Counter as Counts

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_surprisal import _brute

from glyphspark.functions import strata
from glyphspark.operators import chars, counting
from glyphspark.operators.surprisal import Corpus, Setup
from glyphspark.sources import sinks

SCHEMA = "doc_id long, text string"


def test_wide_alphabets_and_long_orders(spark):
    rng = random.Random(8)
    alphabet = [chr(0x4E00 + i) for i in range(290)] + list("ab., 🙂é")
    words = ["".join(rng.choice(alphabet) for _ in range(6)) for _ in range(15)]
    texts = ["".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    c = Corpus(chars.corpus(spark.createDataFrame(list(enumerate(texts)), SCHEMA)), Setup(ks=(1, 2, 9, 15), cap=5))
    want, cov = _brute("".join(t + "\n" for t in texts), (1, 2, 9, 15), 5)
    got = {(r.k, r.ch): (r.sum_surp, r.n_sum, r.n, r.ctx_hit) for r in c.surprisal().collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x][0] - s) < 1e-8 and list(got[x][1:]) == rest for x, (s, *rest) in want.items())
    assert {r.k: (r.hits, r.total) for r in c.coverage().collect()} == cov
    assert c.sums.where("k > 0").count() < c.tally.where("k > 0").count()


def test_no_row_for_a_character(spark):
    c = Corpus(chars.corpus(spark.createDataFrame([(0, "ab, " * 500)], SCHEMA)), Setup(ks=(1, 2)))
    plan = c._count((0, 1, 2), False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_chunks_and_early_sends_lose_nothing(monkeypatch):
    monkeypatch.setattr(counting, "CHUNK", 50)
    rng = random.Random(9)
    whole = "".join(rng.choice("abc") for _ in range(900))
    one = np.zeros((1, 1), np.int64)
    plan = counting.Plan("c", np.array([97, 98, 99]), np.zeros((1, 4), np.uint8), np.array([0]), np.array([0]), np.array([0]), one + 5, one - 1)
    counter, sent = counting.Counter([plan], (1, 5), 0, 3), []
    batch = counting.pa.RecordBatch.from_pylist([{"corpus": "c", "start": 0, "halo": "", "text": whole}])
    for i, (name, rows) in enumerate(counting.texts(iter([batch]))):
        counter.add(name, rows)
        if i % 4 == 3:
            counter.merge()
            sent += counter.emit()
    sent += counter.emit()
    total = Counts()
    for row in sent:
        high = (1, 5)[row["level"]]
        words, counts, tags = counting._unpacked(1, row["n"], row["data"])
        shown = [counting.symbol(words, plan.bits, p) for p in [*reversed(range(high)), high]]
        for *key, n in zip(*shown, counts.tolist(), strict=True):
            total["".join(" abc"[s] for s in key)] += n
    assert {x: n for x, n in total.items() if " " not in x} == Counts(whole[i - k : i + 1] for k in (1, 5) for i in range(k, 900))


def test_strata_take_a_letter_a_character(spark):
    code = "x = 'a' # é🙂\n"
    docs = chars.corpus(spark.createDataFrame([(0, code), (1, "y")], SCHEMA), separator="", language="python")
    assert dict(docs.dtypes)["strata"] == "string"
    names = {r.doc_id: [strata.NAMES[ord(x) - ord("a")] for x in r.strata] for r in docs.collect()}
    assert names == {0: strata.python_strata(code), 1: strata.python_strata("y")}
    assert {r.stratum: r.n for r in strata.counted_strata(docs).collect()} == Counts(names[0] + names[1])


def test_lines_come_from_pieces_of_texts(spark):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("ab é🙂") for _ in range(rng.choice([0, 1, 7, 45])))) for i in range(30)]
    docs = chars.corpus(spark.createDataFrame(texts, SCHEMA))
    placed = chars.place(docs, 1)
    ends = spark.createDataFrame([("all", 333)], "corpus string, high long")
    got = sinks.text_lines(chars.located(docs, placed, 1), ends, 10)
    want = sinks.training_lines(chars.characters(docs, 1, placed=placed).where(F.col("pos") < 333), 10)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 34
    assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_code_points_of_utf8():
    text = "".join(map(chr, [0, 65, 127, 128, 0x7FF, 0x800, 0xFFFD, 0xFFFF, 0x10000, 0x10FFFF])) * 3 + "aé🙂"
    points, n = counting.code_points(np.frombuffer(text.encode(), np.uint8))
    assert dict(zip(points.tolist(), n.tolist(), strict=True)) == Counts(map(ord, text))
    assert counting.code_points(np.zeros(0, np.uint8))[0].tolist() == []


@pytest.mark.parametrize("which", ["plain", "repeated", "null ids", "one id"])
def test_train_frequencies_without_located_documents(spark, monkeypatch, which):
    monkeypatch.setattr(counting, "CHUNK", 7)  # pieces end within documents
    rng = random.Random(which)
    texts = ["".join(rng.choice("abé🙂 ") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    ids = {"plain": range(40), "repeated": range(40), "null ids": [None] * 40, "one id": [3] * 40}[which]
    rows = [(i, "xy"[n % 2], t) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [(31, "x", "same é text")] * 17 if which == "repeated" else []
    docs = chars.corpus(spark.createDataFrame(rows, "doc_id long, name string, text string").repartition(3), name=F.col("name"))
    c = Corpus(docs, Setup(ks=(1, 2)))
    got = {(r.corpus, r.ch): r.freq for r in c.frequencies().collect()}
    assert "located" not in c.__dict__
    want = {}
    for name, n_tr in [(b.corpus, b.n_tr) for b in c.bounds.collect()]:
        joined = "".join(r.text for r in sorted(c.located.where(F.col("corpus") == name).collect(), key=lambda r: r.start))
        want |= {(name, ch): n for ch, n in Counts(joined[:n_tr]).items()}
    assert got == want


def test_lines_are_made_in_blocks_without_lists(spark, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 3)
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("ab é🙂") for _ in range(rng.choice([0, 1, 7, 45, 130])))) for i in range(150)]
    docs = chars.corpus(spark.createDataFrame(texts, SCHEMA), name=F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    c = Corpus(docs, Setup(ks=(1, 2)))
    got = sinks.text_lines(c.placed_texts(), c.bounds.selectExpr("corpus", "n_tr AS high"), 10)
    assert "located" not in c.__dict__ and "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    bounds = {b.corpus: b.n_tr for b in c.bounds.collect()}
    want = []
    for name, n_tr in bounds.items():
        text = "".join(t + "\n" for i, t in texts if (i % 3 == 0) == (name == "x"))[:n_tr]
        want += [(name, i // 10, " ".join(f"{ord(ch):04x}" for ch in text[i : i + 10])) for i in range(0, n_tr, 10)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
