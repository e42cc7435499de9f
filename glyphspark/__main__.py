"""Command line: profiles of a corpus, or the regression panels of several.

    python -m glyphspark profile TEXT [--python] [--max-k 15] [--adaptive] [--cache DIR] [--output DIR] [--top N]
    python -m glyphspark panels NAME=TEXT ... [--code NAME ...] [--tau 0.5] [--output DIR]

TEXT is a file or a folder of files in any place that Spark reads. With a cache, surprisal and coverage of a
corpus that was profiled before, with the same settings, are read instead of computed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify
from .operators import adaptive, chars, panel, regression
from .operators.surprisal import Corpus, Setup
from .sources import cache, sinks, text

#: Orders beyond this are left to other estimators.
CEILING = 15


def documents(spark: SparkSession, path: str, name: str, python: bool = False) -> DataFrame:
    files = text.numbered(text.read_files(spark, path, "*.py" if python else None, recursive=True))
    return chars.corpus(files, name=name, language="python" if python else None)


def measured(corpus: Corpus, store: cache.Cache | None, settings: str) -> tuple[DataFrame, DataFrame]:
    """Surprisal and coverage of a corpus, from the cache if it has all orders."""
    if store is None:
        return corpus.surprisal(), corpus.coverage()
    key, ks = f"{cache.corpus_hash(corpus.documents)}-{settings}", corpus.setup.ks
    for table, make in (("surprisal", corpus.surprisal), ("coverage", corpus.coverage)):
        if store.missing(table, key, ks):
            store.put_missing(table, make(), key)
    return store.get("surprisal", key, ks), store.get("coverage", key, ks)


def profile(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    ks = tuple(range(1, min(a.max_k, CEILING) + 1))
    setup = Setup(ks=ks, classifier=classify.code_profile if a.python else classify.nl_profile)
    corpus = Corpus(documents(spark, a.text, "corpus", a.python), setup)
    table, coverage = measured(corpus, cache.Cache(spark, a.cache) if a.cache else None, "code" if a.python else "text")
    kmax = panel.reliable_kmax(coverage, rule="probes", probes=adaptive.probes(max(ks)))
    if a.adaptive:
        reliable = kmax.first()
        asked = adaptive.adaptive_orders(corpus, min(max(ks), reliable.kmax if reliable else 1), a.patience, n=a.bootstrap_n, alpha=a.bootstrap_alpha, table=table)
        table = table.join(F.broadcast(asked.select("k")), "k")
    gain = panel.context_gain(table, a.min_n)
    rows = panel.profiles(gain, table.where((F.col("k") == 1) & (F.col("n") >= a.min_n)), kmax, max(ks), a.cov_threshold)
    if a.output:
        sinks.write_csv(panel.wide(rows, ks[1:]), f"{a.output}/profiles", 6)
        sinks.write_config(spark, {k: v for k, v in vars(a).items() if k != "run"}, f"{a.output}/config")
    return sinks.top(rows.select(sinks.shown("ch").alias("char"), "type", "s1", "cg_peak", "k_peak", sinks.ngram_label("k_peak").alias("ngram"), "in_reliable", "warn_neural"), "cg_peak", a.top, "char")


def panels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    fits = None
    for item in a.text:
        name, _, path = item.partition("=")
        corpus = Corpus(documents(spark, path, name), Setup(classifier=classify.code_identity if name in a.code else classify.nl))
        rows = chars.stored(panel.panel(panel.context_gain(corpus.surprisal(), a.min_n), panel.reliable_kmax(corpus.coverage()), corpus.frequencies(), corpus.bounds, a.tau), "panel")
        if a.output:
            sinks.write_csv(rows, f"{a.output}/panel_{name}", 6)
        one = regression.beta3(rows, ["corpus"])
        fits = one if fits is None else fits.unionByName(one)
    return regression.forest(fits, F.col("corpus").isin(*a.code) if a.code else F.lit(False))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="glyphspark", description="Context gain of single characters.")
    sub = out.add_subparsers(required=True)
    one = sub.add_parser("profile", help="profiles of the characters of one corpus")
    one.add_argument("text")
    one.add_argument("--python", action="store_true", help="a folder of Python sources, classes by stratum")
    one.add_argument("--adaptive", action="store_true", help="only the orders that the schedule asks for")
    one.add_argument("--max-k", type=int, default=CEILING)
    one.add_argument("--min-n", type=int, default=30)
    one.add_argument("--cov-threshold", type=float, default=0.5)
    one.add_argument("--patience", type=int, default=2)
    one.add_argument("--bootstrap-n", type=int, default=500)
    one.add_argument("--bootstrap-alpha", type=float, default=0.05)
    one.add_argument("--cache", help="folder of cached tables")
    one.add_argument("--output", help="folder for CSV and settings")
    one.add_argument("--top", type=int)
    one.set_defaults(run=profile)
    many = sub.add_parser("panels", help="panels and coefficients of corpora")
    many.add_argument("text", nargs="+", metavar="NAME=TEXT")
    many.add_argument("--code", nargs="*", default=[], metavar="NAME")
    many.add_argument("--min-n", type=int, default=30)
    many.add_argument("--tau", type=float, default=0.5)
    many.add_argument("--output", help="folder for the panels")
    many.set_defaults(run=panels)
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("glyphspark").getOrCreate()
    found = a.run(spark, a)
    widths = {c: 8 if kind in ("int", "bigint", "boolean") else 12 for c, kind in found.dtypes}
    print(sinks.heading(widths, dict(found.dtypes)))
    for r in sinks.text_table(found, widths).toLocalIterator():  # a row for each character or corpus
        print(r.line)


if __name__ == "__main__":
    main()
