"""Context gain, peaks, the regression panel and profiles, from a table of surprisal.

Input rows are (corpus, k, ch, type, sum_surp, sum_sq, n_sum, n, ctx_hit); the base order is k = 1. All
of these tables have a row for a character and an order, so they are small and are joined as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_N, TAU = 30, 0.5


def mean() -> Column:
    return F.col("sum_surp") / F.col("n_sum")


def mean_ci(surprisal: DataFrame, ddof: int = 1) -> DataFrame:
    """mean, lo, hi: normal 95 % interval; ``ddof`` 1 for the sample variance, 0 for the population's."""
    n, m = F.col("n_sum").cast("double"), mean()
    left = F.when(F.col("n_sum") > ddof, n - ddof)  # null for one occurrence, as 1 / 0 has no value
    var = F.greatest((F.col("sum_sq") - n * m * m) / left, F.lit(0.0))
    half = 1.96 * F.sqrt(var) / F.sqrt(n)
    return surprisal.where("n_sum > 0").withColumns({"mean": m, "lo": m - half, "hi": m + half})


def context_gain(surprisal: DataFrame, min_n: int = MIN_N, ddof: int = 1) -> DataFrame:
    """corpus, ch, type, k, s1, sk, cg, coverage, n1 and both intervals for k > 1."""
    rows = mean_ci(surprisal.where(F.col("n") >= min_n), ddof)
    one = rows.where("k = 1").select("corpus", "ch", F.col("mean").alias("s1"), F.col("lo").alias("s1_lo"), F.col("hi").alias("s1_hi"), F.col("n").alias("n1"))
    rest = rows.where("k > 1").select("corpus", "ch", "type", "k", F.col("mean").alias("sk"), F.col("lo").alias("sk_lo"), F.col("hi").alias("sk_hi"), (F.col("ctx_hit") / F.col("n")).alias("coverage"))
    return rest.join(one, ["corpus", "ch"]).withColumn("cg", F.col("s1") - F.col("sk"))


def gradients(gain: DataFrame) -> DataFrame:
    """cg(k) less that of the last eligible order before it."""
    order = Window.partitionBy("corpus", "ch").orderBy("k")
    return gain.withColumn("gradient", F.col("cg") - F.lag("cg").over(order))


def reliable_kmax(coverage: DataFrame, tau: float = TAU, rule: str = "last", probes: tuple[int, ...] = ()) -> DataFrame:
    """corpus, kmax. ``last``: the last order at or above ``tau``; ``first_gap``: the one before the
    first order below it; ``probes``: the last of the probed orders at or above it. 1 if there is none."""
    ok = F.col("coverage") >= tau
    if rule == "probes":
        value = F.max(F.when(ok & F.col("k").isin(*probes), F.col("k")))
    elif rule == "first_gap":
        value = F.coalesce(F.min(F.when((F.col("k") > 1) & ~ok, F.col("k"))) - 1, F.max("k"))
    else:
        value = F.max(F.when(ok & (F.col("k") > 1), F.col("k")))
    return coverage.groupBy("corpus").agg(F.greatest(F.coalesce(value, F.lit(1)), F.lit(1)).alias("kmax"))


def peaks(gain: DataFrame, kmax: DataFrame, gated: bool = False, tau: float = TAU) -> DataFrame:
    """One row a character: the order of the largest gain (the smallest of equals) within the reliable
    range, its conservative interval, coverage there and the remaining share LS."""
    rows = gain.join(F.broadcast(kmax), "corpus").where("k <= kmax")
    if gated:
        rows = rows.where(F.col("coverage") >= tau)
    best = Window.partitionBy("corpus", "ch").orderBy(F.desc("cg"), "k")
    top = rows.withColumn("_at", F.row_number().over(best)).where("_at = 1")
    return top.select(
        "corpus", "ch", "type", F.col("s1").alias("s_x1"), F.col("s1_lo").alias("s_x1_lo"), F.col("s1_hi").alias("s_x1_hi"), F.col("n1").alias("n_test"),
        F.col("cg").alias("cg_peak"), (F.col("s1_lo") - F.col("sk_hi")).alias("cg_lo"), (F.col("s1_hi") - F.col("sk_lo")).alias("cg_hi"),
        F.col("k").alias("k_peak"), F.col("coverage").alias("sym_cov"), F.when(F.col("s1") > 0, 1 - F.col("cg") / F.col("s1")).alias("ls"),
    )


def panel(gain: DataFrame, kmax: DataFrame, frequencies: DataFrame, bounds: DataFrame, tau: float = TAU) -> DataFrame:
    """Rows of the regression: corpus, char_id, k, cg, log2k, structural, log2k_x_s, logfreq."""
    rows = gain.join(F.broadcast(kmax), "corpus").where((F.col("k") <= F.col("kmax")) & (F.col("coverage") >= tau))
    rows = rows.join(frequencies, ["corpus", "ch"], "left").join(F.broadcast(bounds.select("corpus", "n_tr")), "corpus")
    s, log2k = (F.col("type") == "structural").cast("int"), F.log2(F.col("k").cast("double"))
    freq = F.log2(F.greatest(F.coalesce("freq", F.lit(1)) / F.col("n_tr"), F.lit(1e-10)))
    return rows.select("corpus", F.col("ch").alias("char_id"), "k", "cg", log2k.alias("log2k"), s.alias("structural"), (log2k * s).alias("log2k_x_s"), freq.alias("logfreq"))


def mean_gain(rows: DataFrame) -> DataFrame:
    """corpus, char_id, structural, mean_cg, n_k of a panel."""
    return rows.groupBy("corpus", "char_id", "structural").agg(F.avg("cg").alias("mean_cg"), F.count(F.lit(1)).alias("n_k"))


def kpeak_distribution(peaked: DataFrame, kmax: DataFrame) -> DataFrame:
    """Quantiles of k_peak by type and over all, and how many stand at the ceiling."""
    rows = peaked.join(F.broadcast(kmax), "corpus")
    k = F.col("k_peak")
    measures = [F.count(F.lit(1)).alias("n"), F.min(k).alias("k_min"), *[F.percentile(k, F.lit(q)).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))], F.max(k).alias("k_max"), F.count_if(k >= F.col("kmax")).alias("at_ceiling")]
    each = rows.groupingSets([["corpus", "type"], ["corpus"]], "corpus", "type").agg(*measures)
    return each.withColumn("type", F.coalesce("type", F.lit("all")))


def profiles(gain_all: DataFrame, base: DataFrame, kmax: DataFrame, max_k: int, tau: float = TAU) -> DataFrame:
    """corpus, ch, type, s1, trajectory (k, sk, cg, coverage), k_peak, cg_peak, in_reliable, warn_neural.

    ``base`` has every character's row at k = 1; a character without a reliable order falls back to its
    best order of any up to the ceiling.
    """
    rows = gain_all.join(F.broadcast(kmax), "corpus")
    ok = (F.col("k") <= F.col("kmax")) & (F.col("coverage") >= tau)
    # The largest gain, the smallest order among equals.
    best = lambda c: F.max(F.when(c, F.struct("cg", (-F.col("k")).alias("minus_k"), "coverage")))
    each = rows.groupBy("corpus", "ch").agg(
        F.sort_array(F.collect_list(F.struct("k", "sk", "cg", "coverage"))).alias("trajectory"), best(ok).alias("good"), best(F.col("k") <= F.col("kmax")).alias("any")
    )
    full = base.select("corpus", "ch", "type", mean().alias("s1")).join(each, ["corpus", "ch"], "left").join(F.broadcast(kmax), "corpus")
    peak = F.coalesce("good", "any")
    k = (-peak["minus_k"]).cast("int")
    ceiling = F.least(F.col("kmax"), F.lit(max_k))
    warn = F.coalesce((k >= ceiling) & (ceiling < max_k) & (peak["coverage"] >= tau), F.lit(False))
    return full.select("corpus", "ch", "type", "s1", "trajectory", k.alias("k_peak"), peak["cg"].alias("cg_peak"), F.col("good").isNotNull().alias("in_reliable"), F.col("kmax").alias("reliable_k_max"), warn.alias("warn_neural"))


def wide(profile: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """A column for the gain and the coverage of each order."""
    at = lambda k: F.filter("trajectory", lambda t: t["k"] == k)
    cols = {f"{n}_k{k}": F.get(at(k), 0)[f] for k in ks for n, f in (("CG", "cg"), ("cov", "coverage"))}
    return profile.select("corpus", "ch", "type", "s1", "k_peak", "cg_peak", "in_reliable", *[c.alias(n) for n, c in cols.items()])
