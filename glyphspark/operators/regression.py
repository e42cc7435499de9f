"""The clustered regression and its robustness runs, grouped over any number of panels at once.

A panel holds a row for a character and an order, at most vocabulary times orders, so a group fits a
task; groups (corpora, thresholds, excluded characters, permutations) run in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

#: Corpora whose labels are permuted exactly, at most: a million subsets.
MAX_PERMUTED = 20
TERMS = ("intercept", "log2k", "structural", "log2k_x_s", "logfreq")
_FIELDS = "term string, coef double, se double, ci_low double, ci_high double, p_value double, r2 double, n_obs long, n_clusters long, n_structural_clusters long"


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def gated(panel: DataFrame, by: list[str], min_rows: int = 0, min_clusters: int = 0) -> DataFrame:
    """Rows of the groups with so many rows and characters; the published variants ask for 10 rows and 5
    characters with normal intervals, or for 3 characters."""
    if not (min_rows or min_clusters):
        return panel
    big = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("char_id").alias("_g"))
    big = big.where((F.col("_n") >= min_rows) & (F.col("_g") >= min_clusters)).select(*by)
    return panel.join(F.broadcast(big), by)  # a row for each fit


def coefficients(panel: DataFrame, by: list[str], small: bool = True, normal_ci: bool = False, min_rows: int = 0, min_clusters: int = 0) -> DataFrame:
    """All five coefficients of each group; a group without rows, or below the gates, gives none."""
    panel = gated(panel, by, min_rows, min_clusters)

    def fit(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["char_id", "k"])
        r = stats.clustered_ols(rows.cg, stats.design(rows.log2k.to_numpy(), rows.structural.to_numpy(float), rows.logfreq.to_numpy()), rows.char_id.to_numpy(), small, normal_ci)
        out = pd.DataFrame({"term": TERMS, "coef": r["coef"], "se": r["se"], "ci_low": r["lo"], "ci_high": r["hi"], "p_value": r["p"]})
        out = out.assign(r2=r["r2"], n_obs=r["n"], n_clusters=r["g"], n_structural_clusters=rows[rows.structural == 1].char_id.nunique())
        for i, c in enumerate(by):
            out.insert(i, c, keys[i])
        return out

    return panel.groupBy(*by).applyInPandas(fit, f"{_keys(panel, by)}, {_FIELDS}")


def beta3(panel: DataFrame, by: list[str], **how) -> DataFrame:
    """The trajectory coefficient alone."""
    return coefficients(panel, by, **how).where("term = 'log2k_x_s'").drop("term").withColumnRenamed("coef", "beta3")


def stars(table: DataFrame) -> DataFrame:
    p = F.col("p_value")
    return table.withColumn("stars", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def leave_one_out(panel: DataFrame, **how) -> DataFrame:
    """beta3 without each structural character in turn, beside that with all. Fewer than 10 rows are
    skipped; ``status`` is COLLAPSED if no structural character is left."""
    excluded = panel.where("structural = 1").select("corpus", F.col("char_id").alias("excluded")).distinct()
    # A corpus has a few structural characters: the panel is repeated that often.
    held = panel.join(F.broadcast(excluded), "corpus").where("char_id <> excluded")
    big = held.groupBy("corpus", "excluded").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 10").drop("_n")
    out = beta3(held.join(F.broadcast(big), ["corpus", "excluded"]), ["corpus", "excluded"], **how)
    whole = beta3(panel, ["corpus"], **how).select("corpus", F.col("beta3").alias("beta3_all"))
    out = out.join(F.broadcast(whole), "corpus").withColumn("delta", F.col("beta3") - F.col("beta3_all"))
    return out.withColumn("status", F.when(F.col("n_structural_clusters") == 0, "COLLAPSED").otherwise("OK"))


def leave_one_out_summary(loo: DataFrame) -> DataFrame:
    return loo.groupBy("corpus").agg(F.min("beta3").alias("b3_min"), F.max("beta3").alias("b3_max"), F.every(F.col("beta3") > 0).alias("all_positive"), F.some(F.col("beta3") <= 0).alias("any_nonpositive"))


def split_summary(fits: DataFrame) -> DataFrame:
    """corpus, number, range, mean and sample deviation of beta3 over splits, and whether all are positive."""
    b = F.col("beta3")
    return fits.groupBy("corpus").agg(
        F.count(b).alias("n"), F.min(b).alias("b3_min"), F.max(b).alias("b3_max"), F.avg(b).alias("b3_mean"), F.stddev_samp(b).alias("b3_sd"), F.every(b > 0).alias("all_positive")
    )


def forest(fits: DataFrame, is_code: Column) -> DataFrame:
    """A row for each corpus in the order of a forest plot: natural language before code, larger
    coefficients first; ``place`` counts from 1 within the domain."""
    rows = fits.withColumn("is_code", is_code)
    by = Window.partitionBy("is_code").orderBy(F.desc("beta3"), "corpus")  # corpora, a handful
    shown = rows.select("is_code", F.row_number().over(by).alias("place"), "corpus", "beta3", "se", "ci_low", "ci_high", "n_obs", "n_clusters", "n_structural_clusters")
    return shown.orderBy("is_code", "place")


def against_published(found: DataFrame, published: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Published values (keys, measure, published) beside the found ones (keys, measure, value): the
    difference and whether it is within ``tolerance``. What was not found is not within it."""
    both = published.join(found, [*keys, "measure"], "left")
    difference = F.col("value") - F.col("published")
    return both.select(*keys, "measure", "published", "value", difference.alias("difference"), F.coalesce(F.abs(difference) <= tolerance, F.lit(False)).alias("agrees"))


def functional_form(panel: DataFrame) -> DataFrame:
    """log2k, linear and categorical k compared by AIC and BIC; the categorical row has the mean
    interaction over the orders, without error or p."""

    def fit(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["char_id", "k"])
        y, s, f, k = rows.cg.to_numpy(), rows.structural.to_numpy(float), rows.logfreq.to_numpy(), rows.k.to_numpy()
        levels = sorted(set(k))[1:]
        dummies = [(k == v).astype(float) for v in levels]
        forms = {
            "log2k": stats.design(np.log2(k), s, f),
            "linear": stats.design(k.astype(float), s, f),
            "categorical": np.column_stack([np.ones(len(y)), *dummies, s, *[d * s for d in dummies], f]),
        }
        out = []
        for name, x in forms.items():
            r, n, p = stats.clustered_ols(y, x, rows.char_id.to_numpy()), len(y), x.shape[1]
            base = n * math.log(r["rss"] / n) if r["rss"] > 0 else -math.inf
            at = slice(1 + len(levels) + 1, 1 + 2 * len(levels) + 1) if name == "categorical" else slice(3, 4)
            b = float(r["coef"][at].mean()) if len(levels) or name != "categorical" else math.nan
            se, pv = (math.nan, math.nan) if name == "categorical" else (float(r["se"][3]), float(r["p"][3]))
            out.append((keys[0], name, p, base + 2 * p, base + p * math.log(n), b, se, pv, r["r2"]))
        return pd.DataFrame(out, columns=["corpus", "model", "n_params", "aic", "bic", "b_interaction", "se_interaction", "p_interaction", "r2"])

    return panel.groupBy("corpus").applyInPandas(fit, "corpus string, model string, n_params long, aic double, bic double, b_interaction double, se_interaction double, p_interaction double, r2 double")


def label_permutation(panel: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """How often shuffled labels reach the observed beta3. The labels of all permutations come from one
    generator, so a group draws them in order; what depends on no label is solved once."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["char_id", "k"], kind="stable")
        names, at = np.unique(rows.char_id.to_numpy(), return_inverse=True)
        labels = np.array([rows.structural.to_numpy()[at == i][0] for i in range(len(names))], float)
        y, l2, f = rows.cg.to_numpy(), rows.log2k.to_numpy(), rows.logfreq.to_numpy()
        observed = stats.clustered_ols(y, stats.design(l2, labels[at], f), at)
        # y and the two labelled columns, without what the fixed columns explain.
        q = np.linalg.qr(np.column_stack([np.ones(len(y)), l2, f]))[0]
        rest = lambda v: v - q @ (q.T @ v)
        ry, rng, null = rest(y), np.random.default_rng(seed), np.empty(n)
        base = np.sort(labels)[::-1]  # the structural labels first, as the published run starts each shuffle
        for i in range(n):
            shuffled = base.copy()
            rng.shuffle(shuffled)
            s = shuffled[at]
            a, b = rest(s), rest(l2 * s)
            aa, ab, bb, ay, by_ = a @ a, a @ b, b @ b, a @ ry, b @ ry
            det = aa * bb - ab * ab
            null[i] = (aa * by_ - ab * ay) / det if abs(det) > 1e-12 else 0.0
        b3 = float(observed["coef"][3])
        return pd.DataFrame([(keys[0], len(names), int(labels.sum()), int((1 - labels).sum()), b3, float(observed["p"][3]), float((null >= b3).mean()), float(null.mean()), float(null.std()), float(np.percentile(null, 95)), n)],
            columns=["corpus", "n_chars", "n_structural", "n_lexical", "b3_observed", "p_cluster_robust", "p_permutation", "null_b3_mean", "null_b3_sd", "null_b3_95th", "n_permutations"])

    return panel.groupBy("corpus").applyInPandas(run, "corpus string, n_chars long, n_structural long, n_lexical long, b3_observed double, p_cluster_robust double, p_permutation double, null_b3_mean double, null_b3_sd double, null_b3_95th double, n_permutations long")


def mann_whitney(rows: DataFrame, value: str) -> DataFrame:
    """corpus, counts, medians of ``value`` by type, U and the one-sided p that structural is larger."""

    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s, x = part.loc[part.structural == 1, value], part.loc[part.structural == 0, value]
        u, p = stats.mann_whitney_greater(s, x)
        med = lambda v: float(v.median()) if len(v) else math.nan
        return pd.DataFrame([(keys[0], len(s), len(x), med(s), med(x), u, p)], columns=["corpus", "n_struct", "n_lex", "median_struct", "median_lex", "u", "p_value"])

    return rows.groupBy("corpus").applyInPandas(run, "corpus string, n_struct long, n_lex long, median_struct double, median_lex double, u double, p_value double")


def go_decision(tests: DataFrame) -> DataFrame:
    ratio = F.col("median_struct") / F.when(F.col("median_lex") != 0, F.col("median_lex"))
    return tests.withColumn("ratio", ratio).withColumn("go", (F.col("p_value") < 0.05) & (F.coalesce(ratio, F.lit(0.0)) > 1.2))


def domain_permutation(values: DataFrame) -> DataFrame:
    """Exact permutation of which corpora are code: values are (name, is_code, beta3), a few rows.

    Every subset of the size of the natural-language side is a bit mask; sums come from the masks. There
    are 2**n masks, so at most ``MAX_PERMUTED`` corpora are taken.
    """
    if values.count() > MAX_PERMUTED:
        raise ValueError(f"more than {MAX_PERMUTED} corpora")
    return _tested(_subsets(values))


def top_subsets(values: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` subsets whose difference of means is the largest, largest first; ties by the mask."""
    return _subsets(values).select("mask", "stat").orderBy(F.desc("stat"), "mask").limit(n)


def _subsets(values: DataFrame) -> DataFrame:
    """n, n_nl, mask, stat and observed of every subset."""
    listed = values.agg(
        F.sort_array(F.collect_list(F.struct("name", "is_code", "beta3"))).alias("v")
    )  # the corpora, a handful
    n = F.size("v")
    nl = F.size(F.filter("v", lambda x: ~x["is_code"]))
    mask = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)).alias("mask")
    rows = listed.select("v", n.alias("n"), nl.alias("n_nl"), mask).where(F.bit_count("mask") == F.col("n_nl"))
    in_mask = lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1
    total = lambda pick: F.aggregate(F.filter("v", pick), F.lit(0.0), lambda a, x: a + x["beta3"])
    side = total(lambda x, i: in_mask(i)) / F.col("n_nl") - total(lambda x, i: ~in_mask(i)) / (F.col("n") - F.col("n_nl"))
    seen = total(lambda x, i: ~x["is_code"]) / F.col("n_nl") - total(lambda x, i: x["is_code"]) / (F.col("n") - F.col("n_nl"))
    return rows.select("n", "n_nl", "mask", side.alias("stat"), seen.alias("observed"))


def _tested(each: DataFrame) -> DataFrame:
    top = F.col("stat") > F.col("observed") - 1e-10
    return each.groupBy("n", "n_nl", "observed").agg(
        F.count(F.lit(1)).alias("n_permutations"), F.count_if(top).alias("rank"), F.count_if(F.col("stat") >= F.col("observed") - 1e-10).alias("n_ge"),
        (F.count_if(F.col("stat") >= F.col("observed") - 1e-10) / F.count(F.lit(1))).alias("p_one_sided"),
        (F.count_if(F.abs("stat") >= F.abs("observed") - 1e-10) / F.count(F.lit(1))).alias("p_two_sided"),
    )
