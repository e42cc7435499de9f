"""Panels of the robustness runs, which count and gate differently from the main analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .surprisal import Corpus


def uncapped_panel(corpus: Corpus, min_n: int = 30, tau: float = 0.5) -> DataFrame:
    """Panel of a set-membership classifier without a cap: a character's coverage is over all its
    occurrences in the test, those without k characters before them counting as not covered. A corpus of
    several rotations gives one panel for each ``split``."""
    surprisal, by = corpus.surprisal(), [*corpus.by, "ch"]
    m = F.col("sum_surp") / F.col("n_sum")
    one = surprisal.where("k = 1").select(*by, m.alias("s1"))
    rest = surprisal.where("k > 1").select(*by, "type", "k", "n", "ctx_hit", m.alias("sk"))
    seen = corpus.frequencies("test").withColumnRenamed("freq", "n_all")
    rows = rest.join(one, by).join(seen, by).join(corpus.frequencies(), by)
    rows = rows.where((F.col("n_all") >= min_n) & (F.col("n") >= min_n) & (F.col("ctx_hit") / F.col("n_all") >= tau))
    rows = rows.join(F.broadcast(corpus.bounds.select("corpus", "n_tr")), "corpus")
    s, log2k = (F.col("type") == "structural").cast("int"), F.log2(F.col("k").cast("double"))
    return rows.select(*corpus.by, F.col("ch").alias("char_id"), "k", (F.col("s1") - F.col("sk")).alias("cg"), log2k.alias("log2k"), s.alias("structural"), (log2k * s).alias("log2k_x_s"), F.log2(F.col("freq") / F.col("n_tr")).alias("logfreq"))


def purity(corpus: Corpus, structural: str) -> DataFrame:
    """corpus, ch, n_code, n_all of candidate characters in the test, by their stratum."""
    rows = corpus.whole_test(structural)
    return rows.groupBy("corpus", "ch").agg(F.sum(F.when(F.col("stratum") == "code", F.col("n")).otherwise(0)).alias("n_code"), F.sum("n").alias("n_all"))


def stratified_panel(corpus: Corpus, structural: str, min_n: int = 30, tau: float = 0.5, pure: float = 0.5) -> DataFrame:
    """Panel in which a candidate is structural if half of its test occurrences are in code, frequencies
    are those of the whole corpus, and every order counts the same occurrences."""
    surprisal = corpus.surprisal()
    m = F.col("sum_surp") / F.col("n_sum")
    fine = purity(corpus, structural).where(F.col("n_code") / F.col("n_all") >= pure).select("corpus", "ch", F.lit(1).alias("structural"))
    alnum = F.col("ch").rlike(r"^[\p{L}\p{Nd} ]$")
    rows = surprisal.where(F.col("n") >= min_n).join(F.broadcast(fine), ["corpus", "ch"], "left").withColumn("structural", F.coalesce("structural", F.lit(0)))
    rows = rows.where((F.col("structural") == 1) | alnum)
    one = rows.where("k = 1").select("corpus", "ch", m.alias("s1"))
    freq = corpus.letters.withColumnRenamed("n", "freq")
    rest = rows.where((F.col("k") > 1) & (F.col("ctx_hit") / F.col("n") >= tau)).withColumn("sk", m).join(one, ["corpus", "ch"]).join(freq, ["corpus", "ch"])
    rest = rest.join(F.broadcast(corpus.bounds.select(F.col("corpus"), F.col("n").alias("total"))), "corpus")
    log2k = F.log2(F.col("k").cast("double"))
    return rest.select("corpus", F.col("ch").alias("char_id"), "k", (F.col("s1") - F.col("sk")).alias("cg"), log2k.alias("log2k"), "structural", (log2k * F.col("structural")).alias("log2k_x_s"), F.log2(F.col("freq") / F.col("total")).alias("logfreq"))
