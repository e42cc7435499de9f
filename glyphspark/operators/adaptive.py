"""Choosing orders by the gradient of the gain, from one small table of all orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .surprisal import Corpus


def still_climbing(gradients, n: int = 1000, alpha: float = 0.05, seed: int = 42) -> bool:
    """Whether the upper percentile of bootstrapped mean gradients is above zero (a lenient test)."""
    g = np.asarray(gradients, float)
    means = np.random.default_rng(seed).choice(g, (n, len(g))).mean(axis=1)
    return bool(np.percentile(means, 100 * (1 - alpha / 2)) > 0)


def orders_asked(gains: dict[int, dict[str, float]], k_max: int, patience: int = 2, n: int = 1000, alpha: float = 0.05) -> list[tuple[int, float | None]]:
    """k and mean gradient of the orders 1 to ``k_max`` that are asked for: up to the end of the first run
    of ``patience`` idle ones. An order is idle if its gains do not climb above those of the order before,
    over the characters that both have; so is the first."""
    table = pd.DataFrame({k: pd.Series(gains.get(k, {}), dtype=float) for k in range(1, k_max + 1)})
    rises = [steps.dropna().to_numpy() for _, steps in table.diff(axis=1).items()]
    idle = pd.Series([not (len(r) and still_climbing(r, n, alpha)) for r in rises])
    stops = np.flatnonzero(idle.rolling(patience).sum() == patience)
    asked = range(stops[0] + 1 if len(stops) else k_max)
    return [(i + 1, float(rises[i].mean()) if len(rises[i]) else None) for i in asked]


def probes(max_k: int) -> tuple[int, ...]:
    return tuple(sorted({k for k in (1, 2, 4, 8, min(16, max_k), max_k) if k <= max_k}))


def adaptive_orders(corpus: Corpus, k_max: int, patience: int = 2, gate: float = 0.3, n: int = 1000, alpha: float = 0.05, table: DataFrame | None = None) -> DataFrame:
    """step, k, mean_gradient of the orders that the scheduler asks for."""
    table = (corpus.surprisal() if table is None else table).where("n_sum > 0")
    rows = table.select("ch", "k", (F.col("sum_surp") / F.col("n_sum")).alias("s"), (F.col("ctx_hit") / F.col("n")).alias("cov")).collect()  # vocabulary x orders
    one = {r.ch: r.s for r in rows if r.k == 1}
    gains = {k: {r.ch: one[r.ch] - r.s for r in rows if r.k == k and r.ch in one and (k == 1 or r.cov >= gate)} for k in corpus.setup.ks}
    out = [(step, *row) for step, row in enumerate(orders_asked(gains, k_max, patience, n, alpha))]
    return corpus.documents.sparkSession.createDataFrame(out, "step int, k int, mean_gradient double")
