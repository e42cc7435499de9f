import random
import re
import time

import numpy as np
import pytest
import xxhash
from _data import DOCS, SCHEMA, documents

from glyphspark.llm import components, line_dedup, simhash

BLANKS = r"[\x20\x09-\x0D]+"


def _removed(rows):
    """Lines with an earlier line of Jaccard 0.8 or more, by brute force."""
    lines = []
    for doc_id, text in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        for i, line in enumerate(text.split("\n")):
            words = {w for w in re.split(BLANKS, line) if w}
            if words:
                lines.append(((doc_id, i), words))
    out = {}
    for place, a in lines:
        if any(p < place and 9 * len(a & b) >= 4 * (len(a) + len(b)) for p, b in lines):
            out.setdefault(place[0], []).append(place[1])
    return out


def test_removed_lines_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}é" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(12)]
    rows = []
    for doc_id in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            lines.append(rng.choice([" ", "\t", "  "]).join(line) + rng.choice(["", "\r"]))
        rows.append((doc_id, "\n".join(lines), "en", "a", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    want = _removed([r[:2] for r in rows])
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    for doc_id, text, *_ in rows:
        assert texts[doc_id] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want.get(doc_id, []))


def test_groups_of_near_lines_equal_brute_force(spark, monkeypatch):
    """Groups of near copies, some settled at first and some in the index."""
    monkeypatch.setattr(line_dedup, "EARLY", 1)
    monkeypatch.setattr(line_dedup, "SHORT", 28)  # lines of both kinds of bitmap meet
    rng = random.Random(11)
    base = [[f"t{i}w{j}" for j in range(30)] for i in range(3)]
    rows = []
    for doc_id in range(90):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            line[rng.randrange(len(line))] = rng.choice(["common", "usual", f"own{doc_id}", f"n{rng.randint(0, 40)}"])
        del line[: rng.choice([0, 0, 0, 1, 3, 6])]
        rows.append((doc_id, " ".join(line), "en", "a", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()} == _removed([r[:2] for r in rows])


def test_any_share_of_lines_gives_the_same_matches(spark, monkeypatch):
    """The rarity order may be counted on all lines, some or none; words are parted by all six blanks and hashed once."""
    rng = random.Random(23)
    base = [[f"t{i}w{j}é" for j in range(n)] for i, n in enumerate((3, 12, 40, 130, 150))]
    rows = []
    for doc_id in range(50):
        lines = [list(rng.choice(base)) for _ in range(rng.randint(1, 4))]
        for line in lines:
            for _ in range(rng.randint(0, len(line) // 8)):
                line[rng.randrange(len(line))] = rng.choice(["common", f"own{doc_id}", f"n{rng.randint(0, 30)}"])
        rows.append((doc_id, "\n".join("".join(w + rng.choice([" ", "\t", "\v", "\f\r", "  "]) for w in line) for line in lines + [[""]]), "en", "a", 1))
    df, want = spark.createDataFrame(rows, SCHEMA), _removed([r[:2] for r in rows])
    for share in (1, 8, 1 << 60):
        monkeypatch.setattr(line_dedup, "RARITY_SHARE", share)
        assert {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()} == want
    keys = df.select(line_dedup._keys("text", line_dedup._rarity(df)).alias("keys"))
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1


def test_lines_of_one_template_cost_their_number(spark):
    """Lines that share all words but one rare one and are not similar: no pair of them is looked at."""
    rows = [(i, "\n".join(f"Chapter {100 * i + j} of the book" for j in range(100)), "en", "a", 1) for i in range(1000)]
    began = time.time()
    report = line_dedup.line_report(spark.createDataFrame(rows, SCHEMA)).agg({"n_removed": "sum", "n_lines": "sum"}).first()
    assert sorted(report.asDict().values()) == [0, 100_000] and time.time() - began < 120


def test_line_report_takes_awkward_rows(spark, monkeypatch):
    docs = documents(spark)
    rows = line_dedup.line_report(docs).collect()
    assert len(rows) == len(DOCS)
    want = _removed([r[:2] for r in DOCS])
    for r in rows:
        assert list(r.removed) == want.get(r.doc_id, []) and r.n_removed == len(r.removed)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_LINES", 0)
    assert sorted(line_dedup.line_report(docs).collect(), key=str) == sorted(rows, key=str)
    assert line_dedup.line_report(docs.limit(0)).collect() == [] and line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_ids_beyond_32_bits_take_decimal_places(spark):
    rows = [((1 << 60) + i, "alpha beta gamma delta epsilon", "en", "a", 1) for i in range(3)] + [(-5, "another line here", "en", "a", 1)]
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1 << 60) + 1: [0], (1 << 60) + 2: [0]}


def _fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(BLANKS, text) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice(["A", "bÉ", "c\t", "d\n", "ee", "\x1cf", "g\xa0h"]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(text.encode()) == _fingerprint(text), text


def _components(fps):
    roots = list(range(len(fps)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                roots[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("how", [{}, {"crowd": 4, "heavy": 40}])
def test_links_join_exactly_the_balls(spark, monkeypatch, how):
    """Also with prefixes split again and again, down to single variants, and with tiny leaves."""
    if how:
        monkeypatch.setattr(simhash, "LEAF", 50)
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(seed)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                seed ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    made = simhash.links(df, len(fps), **how)
    found = {r.node: r.root for r in components.components(made).collect()}
    want = _components(fps)
    groups: dict = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, set()).add(f)
    got: dict = {}
    for f in signed:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
    with pytest.raises(ValueError):
        simhash.links(df, len(fps), radius=3)


def test_masks_are_all_of_few_bits():
    for bits in (0, 1, 2, 5, 8):
        for most in range(4):
            want = sorted(m for m in range(1 << bits) if m.bit_count() <= most)
            assert sorted(simhash.masks(bits, most).tolist()) == want
    assert len(simhash.masks(64, 2)) == 2081


def test_a_crowd_of_near_fingerprints_is_split(spark):
    rng, centre = random.Random(8), random.Random(9).getrandbits(63)
    fps = {centre}
    while len(fps) < 300:  # all within 4 bits of one centre: one group, crowded on a few prefixes
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 4))))
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    found = components.components(simhash.links(df, len(fps), heavy=150))
    assert [tuple(r) for r in found.groupBy("root").count().collect()] == [(min(fps), 300)]


def test_very_long_and_repeated_texts_link(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, text, "en", "a", 1), (2, text + " tail", "en", "a", 1), (3, "something else altogether here now", "en", "a", 1), (2, text + " tail", "en", "a", 1)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).collect() == []


def test_near_duplicates_take_awkward_rows(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r.fingerprint in {f"{_fingerprint(t):016x}" for d, t, *_ in DOCS if d == r.doc_id}
    ids = {r.doc_id: r.component_id for r in rows}
    assert ids[2] == ids[3] == ids[7] == 2 and ids[1] == ids[6] == 1 and ids[None] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, None, 8], key=str)
    assert simhash.keep_one(docs.limit(0)).collect() == [] and simhash.near_duplicates(docs.limit(0)).collect() == []
    twins = docs.where("doc_id = 6").unionByName(docs.where("doc_id = 6"))
    assert simhash.keep_one(twins).count() == 1


def test_rarity_counts_every_line(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"only{i}") for i in range(200)], "doc_id long, text string")
    rarity = line_dedup._rarity(docs)
    place = F.xxhash64("text").bitwiseAND(line_dedup.RARITY_BUCKETS - 1).cast("int")
    assert docs.select(F.min(F.get(rarity, place)).alias("least")).first().least > 0
