"""Every registered query, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, strata
from ..operators import adaptive, chars, panel, regression, variants
from ..operators.surprisal import Corpus, Setup
from ..sources import sinks, text
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_prepared: dict[tuple, Corpus] = {}

MAIN = Setup()
LANGS = Setup(ks=tuple(range(1, 9)))
#: Published coefficients of eight corpora: name, whether it is code, beta3. Fixed values.
DOMAINS = [("NL1", False, 0.5487), ("NL2", False, 1.1308), ("NL3", False, 0.7115), ("NL4", False, 0.6933), ("NL5", False, 0.6756), ("Code1", True, -0.0243), ("Code2", True, -0.3212), ("Code3", True, 0.0752)]


def clear() -> None:
    """Forget prepared corpora, so that the next query starts from its tables."""
    _prepared.clear()


def prepared(spark: SparkSession, sf_dir: str, which: str, setup: Setup) -> Corpus:
    """The corpus of a table; queries of one session share its stored counts."""
    key = (spark.sparkContext.applicationId, sf_dir, which, setup)
    if key not in _prepared:
        docs = spark.read.parquet(f"{sf_dir}/{'pages' if which.startswith('pages') else 'documents'}.parquet")
        if which.startswith("pages"):
            made = chars.corpus(docs, "html", "page_id", "pages", language="javascript" if which == "pages" else None)
        elif which == "python":
            made = chars.corpus(docs, name="python", language="python")
        else:
            made = chars.corpus(docs.where("lang IS NOT NULL"), name=F.col("lang")) if which == "langs" else chars.corpus(docs)
        _prepared[key] = Corpus(made, setup)
    return _prepared[key]


def main(spark: SparkSession, sf_dir: str) -> Corpus:
    return prepared(spark, sf_dir, "all", MAIN)


def langs(spark: SparkSession, sf_dir: str) -> Corpus:
    return prepared(spark, sf_dir, "langs", LANGS)


def gain_of(c: Corpus, ddof: int = 1) -> DataFrame:
    return panel.context_gain(c.surprisal(), ddof=ddof)


def panel_of(c: Corpus, tau: float = 0.5) -> DataFrame:
    return panel.panel(gain_of(c), panel.reliable_kmax(c.coverage()), c.frequencies(), c.bounds, tau)


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    return df.select(*[F.round(c, special.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _peaks(c: Corpus, gated: bool = False) -> DataFrame:
    return panel.peaks(gain_of(c, ddof=0 if gated else 1), panel.reliable_kmax(c.coverage()), gated)


def char_freq(spark, d):
    return main(spark, d).frequencies()


def vocab_stats(spark, d):
    return langs(spark, d).bounds


def _ngrams(k: int) -> Query:
    return lambda spark, d: main(spark, d).ngrams(k).select("ctx", "ch", "c")


def ctx_totals(spark, d):
    return main(spark, d).totals(2).select("ctx", "total")


def global_coverage(spark, d):
    return rounded(main(spark, d).coverage())


def reliable_kmax(spark, d):
    cov = langs(spark, d).coverage()
    one = lambda rule, name, **how: panel.reliable_kmax(cov, rule=rule, **how).select("corpus", F.col("kmax").alias(name))
    return one("last", "last_reliable").join(one("first_gap", "before_gap"), "corpus").join(one("probes", "last_probe", probes=adaptive.probes(8)), "corpus")


def class_distribution(spark, d):
    each = langs(spark, d).letters.groupBy("corpus", classify.nl(F.col("ch")).alias("class")).agg(F.sum("n").alias("n"))
    total = each.groupBy("corpus").agg(F.sum("n").alias("total"))
    return each.join(F.broadcast(total), "corpus").select("corpus", "class", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))


def surprisal_by_char(spark, d):
    return rounded(main(spark, d).surprisal().drop("corpus"), 3)


def surprisal_kt(spark, d):
    return rounded(main(spark, d).surprisal(alpha=0.5).select("ch", "k", (F.col("sum_surp") / F.col("n_sum")).alias("mean")))


def mean_ci(spark, d):
    s = main(spark, d).surprisal().where("n >= 30")
    population = panel.mean_ci(s, 0).select("ch", "k", F.col("lo").alias("lo_population"), F.col("hi").alias("hi_population"))
    return rounded(panel.mean_ci(s).select("ch", "k", "mean", "lo", "hi").join(population, ["ch", "k"]))


def cg_long(spark, d):
    return rounded(gain_of(main(spark, d)).select("ch", "type", "k", "s1", "sk", "cg", "coverage"))


def cg_gradient(spark, d):
    return rounded(panel.gradients(gain_of(main(spark, d))).select("ch", "k", "gradient"))


def peaks(spark, d):
    return rounded(_peaks(main(spark, d)).drop("corpus"))


def peaks_gated(spark, d):
    return rounded(_peaks(main(spark, d), True).select("ch", "type", "s_x1", "cg_peak", "k_peak", "sym_cov"))


def kpeak_distribution(spark, d):
    c = langs(spark, d)
    return panel.kpeak_distribution(_peaks(c), panel.reliable_kmax(c.coverage()))


def mean_context_gain(spark, d):
    return rounded(panel.mean_gain(panel_of(main(spark, d))).drop("corpus"))


def cross_corpus_summary(spark, d):
    rows = _peaks(langs(spark, d)).groupBy("corpus", "type").agg(F.median("cg_peak").alias("median"), F.avg("cg_peak").alias("mean"), F.count("cg_peak").alias("n"))
    return rounded(rows)


def regression_panel(spark, d):
    return rounded(panel_of(main(spark, d)).drop("corpus"))


def panel_k_histogram(spark, d):
    return panel_of(langs(spark, d)).groupBy("corpus", "k").count().withColumnRenamed("count", "n")


def regression_b3(spark, d):
    return rounded(regression.beta3(panel_of(main(spark, d)), ["corpus"]).select("corpus", F.col("beta3").alias("b3"), "se", "n_obs", "n_clusters", "n_structural_clusters"), 5)


def coef_table(spark, d):
    return regression.stars(regression.coefficients(panel_of(main(spark, d)), ["corpus"]))


def tau_sweep(spark, d):
    c = langs(spark, d)
    table = chars.stored(gain_of(c), "gain")
    kmax = panel.reliable_kmax(c.coverage())
    rows = None
    for tau in (0.25, 0.5, 0.75):
        one = panel.panel(table, kmax, c.frequencies(), c.bounds, tau).withColumn("tau", F.lit(tau))
        rows = one if rows is None else rows.unionByName(one)
    out = regression.beta3(rows, ["corpus", "tau"])
    return rounded(out.select("corpus", "tau", F.col("beta3").alias("b3"), "se", "n_obs", "n_clusters", "n_structural_clusters"), 5)


def loo_structural(spark, d):
    out = regression.leave_one_out(chars.stored(panel_of(main(spark, d)), "panel"))
    return rounded(out.select("excluded", F.col("beta3").alias("b3"), "se", "n_obs", "n_clusters", "n_structural_clusters", "status", "delta"), 5)


def loo_summary(spark, d):
    return rounded(regression.leave_one_out_summary(regression.leave_one_out(chars.stored(panel_of(main(spark, d)), "panel"))), 5)


def forest(spark, d):
    """The languages as corpora, none of them code, with normal intervals."""
    fits = regression.beta3(panel_of(langs(spark, d)), ["corpus"], normal_ci=True, min_rows=10, min_clusters=5)
    return rounded(regression.forest(fits, F.lit(False)), 4)


def coverage_classified(spark, d):
    return rounded(main(spark, d).coverage(classified=True))


def top_mean_gain(spark, d):
    """Characters with two orders or more, the largest mean gain first."""
    rows = panel.mean_gain(panel_of(main(spark, d))).where("n_k >= 2")
    return rounded(sinks.top(rows.select("char_id", "structural", "mean_cg", "n_k"), "mean_cg", None, "char_id"))


def domain_top(spark, d):
    """The ten labellings of the eight corpora with the largest difference."""
    rows = regression.top_subsets(spark.createDataFrame(DOMAINS, "name string, is_code boolean, beta3 double"))
    return rounded(rows)


def functional_form(spark, d):
    return regression.functional_form(panel_of(main(spark, d)))


#: Five splits of one corpus: its text turned by none to four tenths before it is cut.
SPLITS = Setup(classifier=classify.CLASSIFIERS["ascii_alnum_space"], cap=None, test="rotated", rotations=tuple(range(5)))


def _split_fits(spark, d):
    return regression.beta3(variants.uncapped_panel(prepared(spark, d, "all", SPLITS)), ["corpus", "split"])


def split_summary(spark, d):
    return rounded(regression.split_summary(_split_fits(spark, d)), 4)


def split_rotation(spark, d):
    return rounded(_split_fits(spark, d).select("split", F.col("beta3").alias("b3"), "se", "n_obs", "n_clusters"), 5)


def lexical_definition(spark, d):
    rows = None
    for name in ("ascii_alnum_space", "ascii_letters"):
        c = prepared(spark, d, "all", Setup(classifier=classify.CLASSIFIERS[name], cap=None, test="ninth"))
        one = variants.uncapped_panel(c).withColumn("lexical_def", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    out = regression.beta3(rows, ["corpus", "lexical_def"])
    return rounded(out.select("lexical_def", F.col("beta3").alias("b3"), "se", "n_obs", "n_clusters"), 5)


def smoothing(spark, d):
    """beta3 with both smoothers, how far it moves and whether its sign stays."""
    c = main(spark, d)
    kmax, rows = panel.reliable_kmax(c.coverage()), None
    for name, alpha in (("laplace", 1.0), ("kt", 0.5)):
        one = panel.panel(panel.context_gain(c.surprisal(alpha)), kmax, c.frequencies(), c.bounds).withColumn("smoothing", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    wide = regression.beta3(rows, ["corpus", "smoothing"]).groupBy("corpus").pivot("smoothing", ["laplace", "kt"]).agg(F.first("beta3"))
    return rounded(wide.withColumns({"delta": F.col("kt") - F.col("laplace"), "sign_preserved": F.signum("kt") == F.signum("laplace")}), 5)


def domain_permutation(spark, d):
    return rounded(regression.domain_permutation(spark.createDataFrame(DOMAINS, "name string, is_code boolean, beta3 double")))


def label_permutation(spark, d):
    return regression.label_permutation(panel_of(main(spark, d)))


def mann_whitney(spark, d):
    c = langs(spark, d)
    gained = regression.mann_whitney(panel.mean_gain(panel_of(c)), "mean_cg").withColumn("measure", F.lit("mean_cg"))
    rows = _peaks(c).select("corpus", (F.col("type") == "structural").cast("int").alias("structural"), "cg_peak")
    return regression.go_decision(gained.unionByName(regression.mann_whitney(rows, "cg_peak").withColumn("measure", F.lit("cg_peak"))))


def mann_whitney_u(spark, d):
    """U and the medians of the mean gain by type, without the p that needs the exact distribution."""
    rows = regression.mann_whitney(panel.mean_gain(panel_of(langs(spark, d))), "mean_cg")
    return rounded(rows.where("n_struct > 0 AND n_lex > 0").drop("p_value"))


def _shares(rows: DataFrame) -> DataFrame:
    rows = chars.stored(rows, "strata-counts")
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("stratum", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))  # one row


def python_strata(spark, d):
    """Strata of the documents, each read as a Python source."""
    return _shares(strata.counted_strata(prepared(spark, d, "python", CODE).documents, "python"))


#: Code by strata of a Python tokenizer, code by the character alone.
CODE, CODE_IDENTITY = Setup(classifier=classify.code), Setup(classifier=classify.code_identity)


def code_peaks(spark, d):
    return _peaks(prepared(spark, d, "python", CODE))


def code_profile(spark, d):
    c = prepared(spark, d, "python", Setup(classifier=classify.code_profile))
    table = c.surprisal()
    kmax = panel.reliable_kmax(c.coverage(), rule="probes", probes=adaptive.probes(8))
    return panel.profiles(panel.context_gain(table), table.where("k = 1 AND n >= 30"), kmax, 8)


def code_identity_panel(spark, d):
    return rounded(panel_of(prepared(spark, d, "pages_plain", CODE_IDENTITY)).drop("corpus"))


def code_identity_b3(spark, d):
    fit = regression.beta3(panel_of(prepared(spark, d, "pages_plain", CODE_IDENTITY)), ["corpus"])
    return rounded(fit.select("corpus", F.col("beta3").alias("b3"), "se", "n_obs", "n_clusters", "n_structural_clusters"), 5)


JS = Setup(classifier=classify.js_identity, cap=None, test="ninth", least_context=8)


def js_strata(spark, d):
    return _shares(strata.counted_strata(prepared(spark, d, "pages", JS).documents, "javascript"))


def js_purity(spark, d):
    return variants.purity(prepared(spark, d, "pages", JS), classify.JS_SYNTAX)


def js_stratified(spark, d):
    return regression.beta3(variants.stratified_panel(prepared(spark, d, "pages", JS), classify.JS_SYNTAX), ["corpus"], small=False, normal_ci=True)


PROFILE_MAX_K = 15
PROFILE = Setup(ks=tuple(range(1, PROFILE_MAX_K + 1)), classifier=classify.nl_profile)


def _profile_kmax(c: Corpus) -> DataFrame:
    return panel.reliable_kmax(c.coverage(), rule="probes", probes=adaptive.probes(PROFILE_MAX_K))


def _profiles(spark, d):
    c = prepared(spark, d, "all", PROFILE)
    table = c.surprisal()
    return panel.profiles(panel.context_gain(table), table.where("k = 1 AND n >= 30"), _profile_kmax(c), PROFILE_MAX_K)


def profile_trajectory(spark, d):
    return _profiles(spark, d)


def profile_wide(spark, d):
    return rounded(panel.wide(_profiles(spark, d), tuple(range(2, PROFILE_MAX_K + 1))).drop("corpus"))


def adaptive_k(spark, d):
    c = prepared(spark, d, "all", PROFILE)
    reliable = _profile_kmax(c).first()
    return adaptive.adaptive_orders(c, min(PROFILE_MAX_K, reliable.kmax if reliable else 1))


def training_lines(spark, d):
    made = chars.characters(chars.corpus(spark.read.parquet(f"{d}/benchmark.parquet"), doc_id="item_id", name="benchmark"), 1)
    return sinks.training_lines(made).select("line_no", "line")


def corpus_training_lines(spark, d):
    """Training text of the corpus: the train part of the documents."""
    c = main(spark, d)
    return sinks.text_lines(c.placed_texts(), c.bounds.selectExpr("corpus", "n_tr AS high")).select("line_no", "line")


def queries() -> dict[str, Query]:
    return {
        "char_freq": char_freq, "vocab_stats": vocab_stats, "ngram_counts_k1": _ngrams(1), "ngram_counts_k2": _ngrams(2), "ngram_counts_k4": _ngrams(4), "ctx_totals": ctx_totals,
        "global_coverage": global_coverage, "reliable_kmax": reliable_kmax, "class_distribution": class_distribution, "surprisal_by_char": surprisal_by_char, "surprisal_kt": surprisal_kt,
        "mean_ci": mean_ci, "cg_long": cg_long, "cg_gradient": cg_gradient, "peaks": peaks, "peaks_gated": peaks_gated, "kpeak_distribution": kpeak_distribution,
        "mean_context_gain": mean_context_gain, "cross_corpus_summary": cross_corpus_summary, "panel": regression_panel, "panel_k_histogram": panel_k_histogram,
        "regression_b3": regression_b3, "coef_table": coef_table, "tau_sweep": tau_sweep, "loo_structural": loo_structural, "functional_form": functional_form,
        "split_rotation": split_rotation, "lexical_definition": lexical_definition, "smoothing": smoothing, "domain_permutation": domain_permutation, "label_permutation": label_permutation,
        "mann_whitney": mann_whitney, "python_strata": python_strata, "js_strata": js_strata, "js_purity": js_purity, "js_stratified": js_stratified,
        "profile_trajectory": profile_trajectory, "profile_wide": profile_wide, "adaptive_k": adaptive_k, "training_lines": training_lines, "corpus_training_lines": corpus_training_lines,
        "loo_summary": loo_summary, "split_summary": split_summary, "forest": forest, "coverage_classified": coverage_classified, "top_mean_gain": top_mean_gain, "domain_top": domain_top,
        "mann_whitney_u": mann_whitney_u, "code_peaks": code_peaks, "code_profile": code_profile, "code_identity_panel": code_identity_panel, "code_identity_b3": code_identity_b3,
    }


def oracle_sql() -> dict[str, str]:
    plain, by_lang = sql.base(), sql.base(sql.LANGS)
    s, g, p = plain + sql.surprisal(), plain + sql.surprisal() + sql.gain(), plain + sql.surprisal() + sql.gain() + sql.panel()
    ls, lg = by_lang + sql.surprisal(), by_lang + sql.surprisal() + sql.gain()
    peak = lambda gate="": f", pk AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY corpus, ch ORDER BY cg DESC, k) AS place FROM g JOIN kmax USING (corpus) WHERE k <= kmax{gate}) WHERE place = 1)"
    fit = "round(b3, 5) AS b3, round(se, 5) AS se, n_obs, n_clusters"
    out = {
        "char_freq": s + " SELECT corpus, ch, freq FROM freq",
        "vocab_stats": by_lang + " SELECT corpus, n, v AS vocab_size, n_tr, t0, t1 FROM b",
        "ctx_totals": plain + " SELECT ctx, total FROM tot WHERE k = 2",
        "global_coverage": s + " SELECT corpus, k, hits, total, round(hits / total, 6) AS coverage FROM cov",
        "reliable_kmax": ls + " SELECT corpus, coalesce(max(k) FILTER (k > 1 AND hits / total >= 0.5), 1) AS last_reliable, coalesce(min(k) FILTER (k > 1 AND hits / total < 0.5) - 1, max(k)) AS before_gap, coalesce(max(k) FILTER (k IN (1, 2, 4, 8) AND hits / total >= 0.5), 1) AS last_probe FROM cov GROUP BY corpus",
        "class_distribution": f"WITH t AS ({sql.LANGS}), c AS (SELECT corpus, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM t), n AS (SELECT corpus, {sql.KINDS['nl']} AS class, count(*) AS n FROM c GROUP BY ALL) SELECT corpus, class, n, round(100 * n / sum(n) OVER (PARTITION BY corpus), 4) AS percent FROM n",
        "surprisal_by_char": s + " SELECT k, ch, type, round(sum_surp, 3) AS sum_surp, round(sum_sq, 3) AS sum_sq, n_sum, n, ctx_hit FROM s",
        "surprisal_kt": plain + sql.surprisal(0.5) + " SELECT ch, k, round(sum_surp / n_sum, 6) AS mean FROM s",
        "mean_ci": g + ", c0_ AS (SELECT *, 1.96::DOUBLE * sqrt(greatest((sum_sq - n_sum * m * m) / n_sum, 0)) / sqrt(n_sum) AS h0 FROM ci) SELECT ch, k, round(m, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(m - h0, 6) AS lo_population, round(m + h0, 6) AS hi_population FROM c0_",
        "cg_long": g + " SELECT ch, type, k, round(s1, 6) AS s1, round(sk, 6) AS sk, round(cg, 6) AS cg, round(coverage, 6) AS coverage FROM g",
        "cg_gradient": g + " SELECT ch, k, round(cg - lag(cg) OVER (PARTITION BY corpus, ch ORDER BY k), 6) AS gradient FROM g",
        "peaks": g + peak() + " SELECT ch, type, round(s1, 6) AS s_x1, round(s1_lo, 6) AS s_x1_lo, round(s1_hi, 6) AS s_x1_hi, n1 AS n_test, round(cg, 6) AS cg_peak, round(s1_lo - sk_hi, 6) AS cg_lo, round(s1_hi - sk_lo, 6) AS cg_hi, k AS k_peak, round(coverage, 6) AS sym_cov, round(CASE WHEN s1 > 0 THEN 1 - cg / s1 END, 6) AS ls FROM pk",
        "peaks_gated": g + peak(" AND coverage >= 0.5") + " SELECT ch, type, round(s1, 6) AS s_x1, round(cg, 6) AS cg_peak, k AS k_peak, round(coverage, 6) AS sym_cov FROM pk",
        "kpeak_distribution": lg + peak() + " SELECT corpus, coalesce(type, 'all') AS type, count(*) AS n, min(k) AS k_min, quantile_cont(k, 0.25) AS p25, quantile_cont(k, 0.5) AS p50, quantile_cont(k, 0.75) AS p75, max(k) AS k_max, count(*) FILTER (k >= kmax) AS at_ceiling FROM pk JOIN kmax USING (corpus) GROUP BY GROUPING SETS ((corpus, type), (corpus))",
        "mean_context_gain": p + " SELECT char_id, structural, round(avg(cg), 6) AS mean_cg, count(*) AS n_k FROM p GROUP BY char_id, structural",
        "cross_corpus_summary": lg + peak() + " SELECT corpus, type, round(median(cg), 6) AS median, round(avg(cg), 6) AS mean, count(cg) AS n FROM pk GROUP BY corpus, type",
        "panel": p + " SELECT char_id, k, round(cg, 6) AS cg, round(log2k, 6) AS log2k, structural, round(log2k * structural, 6) AS log2k_x_s, round(logfreq, 6) AS logfreq FROM p",
        "panel_k_histogram": lg + sql.panel() + " SELECT corpus, k, count(*) AS n FROM p GROUP BY corpus, k",
        "regression_b3": p + sql.fwl() + f" SELECT corpus, {fit}, n_structural_clusters FROM fit",
        "tau_sweep": lg + ", ".join(["", *[sql.panel(t).strip(", \n").replace("p AS", f"p{i} AS", 1) for i, t in enumerate((0.25, 0.5, 0.75))], "pt AS (SELECT 0.25::DOUBLE AS tau, * FROM p0 UNION ALL SELECT 0.5::DOUBLE, * FROM p1 UNION ALL SELECT 0.75::DOUBLE, * FROM p2)"]) + sql.fwl("pt", "corpus, tau") + f" SELECT corpus, tau, {fit}, n_structural_clusters FROM fit",
        "loo_structural": p + ", e AS (SELECT DISTINCT char_id AS excluded FROM p WHERE structural = 1), pe AS (SELECT excluded, p.* FROM p, e WHERE char_id <> excluded UNION ALL SELECT '(none)', p.* FROM p)" + sql.fwl("pe", "excluded") + f" SELECT excluded, {fit}, n_structural_clusters, CASE WHEN n_structural_clusters = 0 THEN 'COLLAPSED' ELSE 'OK' END AS status, round(b3 - (SELECT b3 FROM fit WHERE excluded = '(none)'), 5) AS delta FROM fit WHERE excluded <> '(none)'",
        "domain_permutation": "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(c).lower()}, {b}::DOUBLE)" for i, (_, c, b) in enumerate(sorted(DOMAINS))) + ") AS t(i, is_code, b)), m AS (SELECT mask FROM range(256) r(mask) WHERE bit_count(mask::INT) = 5), s AS (SELECT mask, avg(b) FILTER ((mask >> i) & 1 = 1) - avg(b) FILTER ((mask >> i) & 1 = 0) AS stat FROM m, v GROUP BY mask), o AS (SELECT avg(b) FILTER (NOT is_code) - avg(b) FILTER (is_code) AS observed FROM v) SELECT 8 AS n, 5 AS n_nl, round(observed, 6) AS observed, count(*) AS n_permutations, count(*) FILTER (stat > observed - 1e-10) AS rank, count(*) FILTER (stat >= observed - 1e-10) AS n_ge, round(count(*) FILTER (stat >= observed - 1e-10) / count(*), 6) AS p_one_sided, round(count(*) FILTER (abs(stat) >= abs(observed) - 1e-10) / count(*), 6) AS p_two_sided FROM s, o GROUP BY observed",
        "training_lines": "WITH t AS (SELECT item_id, text || chr(10) AS text FROM benchmark WHERE text IS NOT NULL), o AS (SELECT regexp_extract_all(text, '(?s).') AS a, sum(length(text)) OVER (ORDER BY item_id) - length(text) AS start FROM t), c AS (SELECT CAST(start + generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS ch FROM o) SELECT pos // 1000 AS line_no, string_agg(lower(printf('%04x', unicode(ch))), ' ' ORDER BY pos) AS line FROM c GROUP BY ALL",
        "profile_wide": sql.base(k=15).replace(sql.KINDS["nl"], sql.KINDS["nl"].replace("WHEN ch IN (' ', chr(10), chr(9)) THEN 'ambiguous'", "WHEN ch = ' ' THEN 'lexical'")) + sql.surprisal() + sql.gain()
        + ", km AS (SELECT coalesce(max(k) FILTER (k IN (1, 2, 4, 8, 15) AND hits / total >= 0.5), 1) AS km FROM cov), one AS (SELECT ch, type, sum_surp / n_sum AS s1 FROM s WHERE k = 1 AND n >= 30), "
        "r AS (SELECT g.*, row_number() OVER (PARTITION BY ch ORDER BY (k <= km AND coverage >= 0.5) DESC, cg DESC, k) AS place, k <= km AND coverage >= 0.5 AS ok FROM g, km) "
        "SELECT one.ch, one.type, round(one.s1, 6) AS s1, k AS k_peak, round(cg, 6) AS cg_peak, coalesce(ok, false) AS in_reliable, "
        + ", ".join(f"round((SELECT cg FROM g WHERE g.ch = one.ch AND k = {k}), 6) AS CG_k{k}, round((SELECT coverage FROM g WHERE g.ch = one.ch AND k = {k}), 6) AS cov_k{k}" for k in range(2, 16)) + " FROM one LEFT JOIN r ON r.ch = one.ch AND place = 1",
    }
    loo = out["loo_structural"]
    out["loo_summary"] = f"SELECT 'all' AS corpus, min(b3) AS b3_min, max(b3) AS b3_max, bool_and(b3 > 0) AS all_positive, bool_or(b3 <= 0) AS any_nonpositive FROM ({loo})"
    lp = lg + sql.panel()
    out["forest"] = lp + ", pg AS (SELECT * FROM p WHERE corpus IN (SELECT corpus FROM p GROUP BY corpus HAVING count(*) >= 10 AND count(DISTINCT char_id) >= 5))" + sql.fwl("pg") + (
        " SELECT false AS is_code, row_number() OVER (ORDER BY b3 DESC, corpus) AS place, corpus, round(b3, 4) AS beta3, round(se, 4) AS se, round(b3 - 1.96::DOUBLE * se, 4) AS ci_low, round(b3 + 1.96::DOUBLE * se, 4) AS ci_high, n_obs, n_clusters, n_structural_clusters FROM fit"
    )
    out["coverage_classified"] = plain + sql.surprisal() + " SELECT corpus, k, CAST(sum(ctx_hit) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total, round(sum(ctx_hit) / sum(n), 6) AS coverage FROM s GROUP BY corpus, k"
    out["top_mean_gain"] = p + " SELECT char_id, structural, round(avg(cg), 6) AS mean_cg, count(*) AS n_k FROM p GROUP BY char_id, structural HAVING count(*) >= 2"
    out["domain_top"] = out["domain_permutation"].split(", o AS (")[0] + " SELECT CAST(mask AS BIGINT) AS mask, round(stat, 6) AS stat FROM s ORDER BY s.stat DESC, mask LIMIT 10"
    ranked = "m AS (SELECT corpus, char_id, structural, avg(cg) AS v FROM p GROUP BY ALL), u AS (SELECT a.corpus, sum(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS u FROM m a JOIN m b ON a.corpus = b.corpus AND a.structural = 1 AND b.structural = 0 GROUP BY a.corpus)"
    out["mann_whitney_u"] = lp + f", {ranked} SELECT m.corpus, count(*) FILTER (structural = 1) AS n_struct, count(*) FILTER (structural = 0) AS n_lex, round(median(v) FILTER (structural = 1), 6) AS median_struct, round(median(v) FILTER (structural = 0), 6) AS median_lex, round(any_value(u), 6) AS u FROM m JOIN u ON m.corpus = u.corpus GROUP BY m.corpus"
    kt = sql.base() + sql.surprisal(0.5) + sql.gain() + sql.panel()
    one = lambda ctes: f"(WITH q AS ({ctes} SELECT * FROM p)" + sql.fwl("q") + " SELECT corpus, b3 FROM fit)"
    out["smoothing"] = f"SELECT a.corpus, round(a.b3, 5) AS laplace, round(b.b3, 5) AS kt, round(b.b3 - a.b3, 5) AS delta, sign(b.b3) = sign(a.b3) AS sign_preserved FROM {one(p)} a JOIN {one(kt)} b ON a.corpus = b.corpus"
    code = sql.base(sql.PAGES, kind="code_identity") + sql.surprisal() + sql.gain() + sql.panel()
    out["code_identity_panel"] = code + " SELECT char_id, k, round(cg, 6) AS cg, round(log2k, 6) AS log2k, structural, round(log2k * structural, 6) AS log2k_x_s, round(logfreq, 6) AS logfreq FROM p"
    out["code_identity_b3"] = code + sql.fwl() + f" SELECT corpus, {fit}, n_structural_clusters FROM fit"
    quoted = "|".join(rf"{q}(?:\\.|[^{q}])*(?:{q}|\z)" for q in "\"'`").replace("'", "''")
    js = rf"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|{quoted}"
    out["js_strata"] = f"WITH t AS (SELECT html || chr(10) AS c, regexp_extract_all(html || chr(10), '{js}') AS m FROM pages WHERE html IS NOT NULL), r AS (SELECT length(c) AS n, m, list_sum([length(x) FOR x IN m IF starts_with(x, '/')]) AS comment, list_sum([length(x) FOR x IN m IF NOT starts_with(x, '/')]) AS string FROM t), s AS (SELECT sum(n) AS n, sum(coalesce(comment, 0)) AS comment, sum(coalesce(string, 0)) AS string FROM r), a AS (SELECT 'comment' AS stratum, comment AS c FROM s UNION ALL SELECT 'string', string FROM s UNION ALL SELECT 'code', n - comment - string FROM s) SELECT stratum, CAST(c AS BIGINT) AS n, round(100 * c / n, 4) AS percent FROM a, s WHERE c > 0"
    for k in (1, 2, 4):
        out[f"ngram_counts_k{k}"] = sql.base(k=k) + f" SELECT ctx, ch, c FROM ng WHERE k = {k}"

    def uncapped(kind: str, test: str, rotation: int = 0) -> str:
        """The panel of one robustness run as a subquery."""
        return "(" + sql.base(kind=kind, test=test, cap=None, rotation=rotation) + sql.surprisal() + """, al AS (SELECT ch, count(*) AS n_all FROM parts WHERE NOT train GROUP BY ch)
SELECT s.ch AS char_id, s.k, o.sum_surp / o.n_sum - s.sum_surp / s.n_sum AS cg, log2(s.k) AS log2k, CASE WHEN s.type = 'structural' THEN 1 ELSE 0 END AS structural, log2(freq / n_tr) AS logfreq
FROM s JOIN s o ON s.ch = o.ch AND o.k = 1 JOIN al ON al.ch = s.ch JOIN freq ON freq.ch = s.ch, b WHERE s.k > 1 AND n_all >= 30 AND s.n >= 30 AND s.ctx_hit / n_all >= 0.5)"""

    each = lambda name, runs: "WITH pp AS (" + " UNION ALL ".join(f"SELECT {label} AS {name}, * FROM {rows}" for label, rows in runs) + ")" + sql.fwl("pp", name) + f" SELECT {name}, {fit} FROM fit"
    out["lexical_definition"] = each("lexical_def", [(f"'{k}'", uncapped(k, "ninth")) for k in ("ascii_alnum_space", "ascii_letters")])
    out["split_summary"] = "WITH pp AS (" + " UNION ALL ".join(f"SELECT {i} AS split, * FROM {uncapped('ascii_alnum_space', 'rotated', i)}" for i in range(5)) + ")" + sql.fwl("pp", "split") + " SELECT 'all' AS corpus, count(b3) AS n, round(min(b3), 4) AS b3_min, round(max(b3), 4) AS b3_max, round(avg(b3), 4) AS b3_mean, round(stddev_samp(b3), 4) AS b3_sd, bool_and(b3 > 0) AS all_positive FROM fit"
    out["split_rotation"] = each("split", [(str(i), uncapped("ascii_alnum_space", "rotated", i)) for i in range(5)])
    return out
