"""Goldens and brute force for the character analysis."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspark.functions import classify, stats
from glyphspark.operators import adaptive, chars, panel, regression
from glyphspark.operators.surprisal import Corpus, Setup


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def _kind(ch):
    if ch in ",.;:?!'\"()[]{}":
        return "structural"
    return None if ch in " \n\t" else "lexical" if ch.isalpha() or ch.isdigit() else None


def _brute(text, ks, cap, alpha=1.0):
    n = len(text)
    tr, te = text[: int(0.8 * n)], text[int(0.8 * n) + int(0.1 * n) :]
    v, out, cov = len(set(text)), {}, {}
    for k in ks:
        grams = defaultdict(Counter)
        for i in range(k, len(tr)):
            grams[tr[i - k : i]][tr[i]] += 1
        hits = 0
        for i in range(k, len(te)):
            ctx, ch = te[i - k : i], te[i]
            hits += ctx in grams
            if _kind(ch):
                row = out.setdefault((k, ch), [0.0, 0, 0, 0])
                row[2] += 1
                row[3] += ctx in grams
                if row[1] < cap:
                    row[1] += 1
                    row[0] -= math.log2((grams[ctx][ch] + alpha if ctx in grams else alpha) / ((sum(grams[ctx].values()) if ctx in grams else 0) + alpha * v))
        cov[k] = (hits, max(0, len(te) - k))
    return out, cov


@pytest.mark.parametrize("seed", range(3))
def test_surprisal_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab. e🙂,é" if seed else "ab"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 200, 300]))) for _ in range(12)]
    whole = "".join(t + "\n" for t in texts)
    c = Corpus(chars.corpus(_docs(spark, texts)), Setup(ks=(1, 2, 3, 5), cap=7))
    got = {(r.k, r.ch): (r.sum_surp, r.n_sum, r.n, r.ctx_hit) for r in c.surprisal().collect()}
    want, cov = _brute(whole, (1, 2, 3, 5), 7)
    assert got.keys() == want.keys()
    for key, (s, *rest) in want.items():
        assert abs(got[key][0] - s) < 1e-8 and list(got[key][1:]) == rest, key
    assert {r.k: (r.hits, r.total) for r in c.coverage().collect()} == {k: v for k, v in cov.items() if v[1]}
    total = {r.k: r.c for r in c.ngrams().groupBy("k").agg(F.sum("c").alias("c")).collect()}
    n_tr = int(0.8 * len(whole))
    assert total == {k: n_tr - k for k in (1, 2, 3, 5) if n_tr > k}


def test_micro_corpus(spark):
    text = "abcab" * 4 + "abc." * 5
    c = Corpus(chars.corpus(_docs(spark, [text]), separator=""), Setup(ks=(1, 2, 3)))
    got = {(r.ch, r.k): (round(r.sum_surp, 12), r.n_sum, r.n, r.ctx_hit) for r in c.surprisal().collect()}
    assert got == {
        ("b", 1): (0.321928094887, 1, 1, 1), ("c", 1): (0.906890595609, 1, 1, 1), (".", 1): (1.459431618637, 1, 1, 1),
        ("c", 2): (0.906890595609, 1, 1, 1), (".", 2): (1.459431618637, 1, 1, 1), (".", 3): (1.459431618637, 1, 1, 1),
    }


def test_rotation_wraps_the_corpus(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc d") for _ in range(50)) for _ in range(4)]
    whole = "".join(t + "\n" for t in texts)
    n, i = len(whole), 3
    turned = whole[int(n * i / 5 / 2) :] + whole[: int(n * i / 5 / 2)]
    c = Corpus(chars.corpus(_docs(spark, texts)), Setup(ks=(1, 3), cap=None, test="rotated", rotation=i, classifier=classify.CLASSIFIERS["ascii_alnum_space"]))
    grams = Counter(turned[p - 3 : p] + turned[p] for p in range(3, int(n * 0.8)))
    assert {r.ctx + r.ch: r.c for r in c.ngrams().where("k = 3").collect()} == grams


def test_empty_corpus(spark):
    c = Corpus(chars.corpus(_docs(spark, []).where("false")), Setup(ks=(1, 2)))
    assert c.surprisal().collect() == [] and c.coverage().collect() == []


def test_golden_panel_and_regression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    c = Corpus(chars.corpus(docs), Setup())
    b = c.bounds.first()
    assert (b.n, b.vocab_size, b.n_tr, b.t0) == (485288, 99, 388230, 388230 + 48528)
    rows = panel.panel(panel.context_gain(c.surprisal()), panel.reliable_kmax(c.coverage()), c.frequencies(), c.bounds)
    fit = {r.term: r for r in regression.coefficients(rows, ["corpus"]).collect()}
    want = {"intercept": -1.262877, "log2k": -1.069106, "structural": -1.106220, "log2k_x_s": 0.617358, "logfreq": -0.550952}
    assert all(abs(fit[t].coef - v) < 1e-6 for t, v in want.items())
    r = fit["log2k_x_s"]
    assert abs(r.se - 0.167186) < 1e-6 and abs(r.p_value - 0.000695) < 1e-6 and abs(r.r2 - 0.716741) < 1e-6 and (r.n_obs, r.n_clusters) == (254, 39)


def test_statistics():
    assert abs(stats.t_p_two_sided(2.0, 10) - 0.07338803) < 1e-7 and abs(stats.t_quantile(0.975, 10) - 2.228138852) < 1e-7
    assert stats.mann_whitney_greater([4, 5], [1, 2, 3]) == (6.0, 0.1)
    high, low = list(range(10, 30)), [x + 0.5 for x in range(20)]
    u, p = stats.mann_whitney_greater(high, low)
    assert u == sum(a > b for a in high for b in low) and 0 < p < 0.01
    assert math.isnan(stats.mann_whitney_greater([], [1])[0])
    one = stats.clustered_ols(np.arange(6.0), np.column_stack([np.ones(6), np.arange(6.0)]), np.zeros(6))
    assert np.allclose(one["coef"], [0, 1]) and np.isnan(one["se"]).all()


def test_peaks_take_the_smallest_of_equal_orders(spark):
    rows = [("c", "a", "lexical", k, 1.0, 1.0 - g, g, 0.9, 40) for k, g in ((2, 0.5), (3, 0.7), (4, 0.7), (5, 0.9))]
    gain = spark.createDataFrame(rows, "corpus string, ch string, type string, k int, s1 double, sk double, cg double, coverage double, n1 long")
    for side in ("s1", "sk"):
        gain = gain.withColumns({f"{side}_lo": F.col(side) - 0.1, f"{side}_hi": F.col(side) + 0.1})
    kmax = spark.createDataFrame([("c", 4)], "corpus string, kmax int")
    top = panel.peaks(gain, kmax).first()
    assert top.k_peak == 3 and abs(top.cg_lo - 0.5) < 1e-9 and abs(top.cg_hi - 0.9) < 1e-9 and abs(top.ls - 0.3) < 1e-9
    cov = spark.createDataFrame([("c", k, v) for k, v in ((1, 1.0), (2, 0.9), (3, 0.4), (4, 0.5))], "corpus string, k int, coverage double")
    assert [panel.reliable_kmax(cov, rule=r, probes=(1, 2, 3)).first().kmax for r in ("last", "first_gap", "probes")] == [4, 2, 2]


def test_permutations(spark):
    values = [("a", False, 1.0), ("b", False, 0.9), ("c", False, 0.8), ("d", True, 0.1), ("e", True, 0.2)]
    r = regression.domain_permutation(spark.createDataFrame(values, "name string, is_code boolean, beta3 double")).first()
    assert (r.n_permutations, r["rank"], r.n_ge) == (10, 1, 1) and abs(r.observed - 0.75) < 1e-9


def test_leave_one_out_and_forms(spark):
    rng = np.random.default_rng(0)
    rows = [("c", ch, k, float(rng.normal()), math.log2(k), int(ch in ".,"), math.log2(k) * (ch in "., "), float(-i)) for i, ch in enumerate(".,abcdef") for k in range(2, 7)]
    p = spark.createDataFrame(rows, "corpus string, char_id string, k int, cg double, log2k double, structural int, log2k_x_s double, logfreq double")
    loo = {r.excluded: r for r in regression.leave_one_out(p).collect()}
    assert loo.keys() == {".", ","} and all(r.n_clusters == 7 and r.status == "OK" for r in loo.values())
    alone = regression.leave_one_out(p.where("char_id <> ','")).first()
    assert alone.status == "COLLAPSED"
    forms = {r.model: r.n_params for r in regression.functional_form(p).collect()}
    assert forms == {"log2k": 5, "linear": 5, "categorical": 11}
    null = regression.label_permutation(p, n=50).first()
    assert null.n_permutations == 50 and null.n_structural == 2 and 0 <= null.p_permutation <= 1


def test_orders_stop_after_patience():
    gains = {k: {c: min(k, 3) + 0.01 * i for i, c in enumerate("abcd")} for k in range(1, 11)}
    asked = adaptive.orders_asked(gains, 10, patience=2)
    assert [k for k, _ in asked] == [1, 2, 3, 4, 5] and [m for _, m in asked] == [None, pytest.approx(1), pytest.approx(1), pytest.approx(0), pytest.approx(0)]
    assert [k for k, _ in adaptive.orders_asked(gains, 3)] == [1, 2, 3] and [k for k, _ in adaptive.orders_asked({}, 5)] == [1, 2]
    assert adaptive.probes(10) == (1, 2, 4, 8, 10)
