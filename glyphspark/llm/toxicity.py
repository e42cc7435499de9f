"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by itself and by its character n-grams (with marks at both ends): half its own embedding and
half its n-grams' mean one, and beside them two prior evidences, the log-odds of the word and the largest
of its n-grams, counted by documents of either label. While training, a document's evidences come from the
other folds of the sample, so the network learns how far to trust them on texts that it has not seen. It
reads windows of ``WINDOW`` words that start every ``STRIDE`` words, so they overlap and cover the whole
text; a text's score is that of its most toxic window.

It is trained on a bounded sample of labelled documents: first on windows with their document's label,
then in rounds on each document's highest window. At the end the threshold is moved to 0.5, by the scores
that the sample's documents get with the evidences of the other folds. Everything is seeded and trained
in doubles, so reruns agree.

A null or empty text is one window without words and scores what the bias says. Very long texts are scored
whole, in windows; of the sample's texts at most ``TRAIN_WORDS`` words are learned from, in blocks spread
evenly over the text. Equal texts score alike, so repeated rows and ties do; documents of the sample are
those whose hashes are below a bound that follows from the number of labels. An empty table gives an
empty one; without labels of both kinds every score is 0. Only doc_id and text are read for a score,
whatever other columns are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, utf8

WINDOW, STRIDE = 64, 48
#: Labelled documents trained on, about so many of each label, and words of one of them at most.
SAMPLE_PER_LABEL, TRAIN_WORDS = 1_500, 8_192
#: Rows of each embedding table, width of the network's input (with the evidences), hidden units of a
#: direction, attention units.
ROWS, WIDTH, HIDDEN, ATTENTION = 1 << 13, 14, 12, 12
#: Evidences of a word, rows of their tables, folds that they are counted in.
EVIDENCES, EVIDENCE_ROWS, FOLDS = 2, 1 << 16, 5
_CACHE = 250_000
Params = dict[str, np.ndarray]


def fold(doc_id: str = "doc_id", mod: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one after the other, and where each word's begin: first that of the word
    itself, then those of its 3-, 4- and 5-grams of characters, its ends counting as characters."""
    from zlib import crc32

    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = "\n" + b"\n".join(words).decode("utf-8", "replace").lower() + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(codes == 10)
    owner, hashes = [np.arange(len(words))], [np.array([crc32(w.lower()) for w in words], np.int64)]
    for n in (3, 4, 5):
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + codes[i : i + m] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        inside = np.flatnonzero(ends[n - 2 : n - 2 + m] == ends[:m])  # no end but the first or last character
        owner.append(ends[inside] - 1)
        hashes.append((h[inside] >> np.uint32(7)).astype(np.int64))
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return hashes[order], np.searchsorted(owner[order], np.arange(len(words)))


def _by_words(starts: np.ndarray, total: int, step: int = 10_000) -> list[tuple[slice, slice]]:
    """Slices of words and of their hashes, so that what is made of them is small at any time."""
    ends = np.append(starts, total)
    return [(slice(i, min(i + step, len(starts))), slice(int(ends[i]), int(ends[min(i + step, len(starts))]))) for i in range(0, len(starts), step)]


def table_rows(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Rows of a table of ``2 * size``: words in the first half, n-grams in the second."""
    rows = hashes % size + size
    rows[starts] -= size
    return rows


def evidence_table(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of each row from the documents of either label (``n``) that hold it (``seen``): 0 for a row
    that neither holds, and shrunk towards 0 by one document in all."""
    share = n / max(1, n.sum())
    odds = np.log((seen[1] + share[1]) / max(n[1], 1e-9)) - np.log((seen[0] + share[0]) / max(n[0], 1e-9))
    return odds / 4  # about the size of the other inputs


def evidences_of(table: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[words, 2]: the evidence of each word itself and the largest of its n-grams."""
    found = table[table_rows(hashes, starts, len(table) // 2)]
    own = found[starts].copy()
    found[starts] = -np.inf
    most = np.maximum.reduceat(found, starts)
    return np.stack([own, np.where(np.isfinite(most), most, 0)], axis=1)


def init(seed: int = 7, dtype=np.float32, width: int = WIDTH, hidden: int = HIDDEN, attention: int = ATTENTION, rows: int = ROWS) -> Params:
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.1, (2 * rows, max(1, width - EVIDENCES)))}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, width**-0.5, (width, 3 * hidden)), f"U{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"c{d}": np.zeros(3 * hidden), f"n{d}": np.zeros(hidden)}
    p |= {"A": rng.normal(0, 0.3, (2 * hidden, attention)), "v": rng.normal(0, 0.3, attention), "o": rng.normal(0, 0.3, 2 * hidden), "bias": np.zeros(1)}
    return {k: x.astype(dtype) for k, x in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(p: Params, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States [T, B, H] of one direction, in reading order; x is [T, B, width]."""
    hidden, u = p[f"n{d}"].size, p[f"U{d}"]
    steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    inputs = x @ p[f"W{d}"] + p[f"c{d}"]
    h = np.zeros((x.shape[1], hidden), x.dtype)
    out, held = np.empty((*x.shape[:2], hidden), x.dtype), []
    for t in steps:
        a = h @ u
        g = _sigmoid(inputs[t, :, : 2 * hidden] + a[:, : 2 * hidden])
        z, r = g[:, :hidden], g[:, hidden:]
        inner = a[:, 2 * hidden :] + p[f"n{d}"]
        n = np.tanh(inputs[t, :, 2 * hidden :] + r * inner)
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if keep:
            held.append((t, h, z, r, n, inner, m))
        out[t] = h = new
    return out, held


def _gru_back(p: Params, d: str, x: np.ndarray, held: list, dout: np.ndarray, grads: Params) -> np.ndarray:
    hidden, u = p[f"n{d}"].size, p[f"U{d}"]
    dinputs = np.zeros((*x.shape[:2], 3 * hidden), x.dtype)
    dh = np.zeros((x.shape[1], hidden), x.dtype)
    du, dn0 = np.zeros_like(u), np.zeros_like(p[f"n{d}"])
    for t, h, z, r, n, inner, m in reversed(held):
        dh = dh + dout[t]
        dn = dh * m * (1 - z) * (1 - n * n)
        dz = -dh * m * (n - h) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        dinputs[t] = np.concatenate([dz, dr, dn], axis=1)
        du += h.T @ da
        dn0 += (dn * r).sum(0)
        dh = dh * (1 - m * (1 - z)) + da @ u.T
    flat = dinputs.reshape(-1, 3 * hidden)
    grads[f"U{d}"], grads[f"n{d}"], grads[f"c{d}"] = du, dn0, flat.sum(0)
    grads[f"W{d}"] = x.reshape(-1, x.shape[2]).T @ flat
    return dinputs @ p[f"W{d}"].T


def forward(p: Params, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits [B] of windows: x [T, B, width], mask [T, B] (1: a word)."""
    parts = {d: _gru(p, d, x, mask, keep) for d in "fb"}
    states = np.concatenate([parts["f"][0], parts["b"][0]], axis=2)
    u = np.tanh(states @ p["A"])
    e = np.where(mask > 0, u @ p["v"], -1e9)
    w = np.exp(e - e.max(0)) * mask
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = (w[:, :, None] * states).sum(0)
    return pooled @ p["o"] + p["bias"][0], (parts, states, u, w, pooled)


def infer(p: Params, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The logits of ``forward``, with both directions in one loop and nothing kept but the states."""
    hidden, (steps, size, _) = p["nf"].size, x.shape
    u, n0 = np.stack([p["Uf"], p["Ub"]]), np.stack([p["nf"], p["nb"]])[:, None]
    inputs = np.stack([x @ p["Wf"] + p["cf"], (x @ p["Wb"] + p["cb"])[::-1]], axis=1)
    masks = np.stack([mask, mask[::-1]], axis=1)[..., None]
    states, h = np.empty((2, steps, size, hidden), x.dtype), np.zeros((2, size, hidden), x.dtype)
    whole = masks.min(axis=(1, 2, 3)) > 0
    for t in range(steps):
        a = np.matmul(h, u)
        a[..., 2 * hidden :] += n0
        g = a[..., : 2 * hidden]
        g += inputs[t, ..., : 2 * hidden]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        n = a[..., 2 * hidden :]
        n *= g[..., hidden:]
        n += inputs[t, ..., 2 * hidden :]
        np.tanh(n, out=n)
        # h + (1 - z)(n - h)
        n -= h
        n *= 1 - g[..., :hidden]
        if not whole[t]:
            n *= masks[t]
        h += n
        states[0, t], states[1, steps - 1 - t] = h[0], h[1]
    a, o = p["A"], p["o"]
    e = np.tanh(states[0] @ a[:hidden] + states[1] @ a[hidden:]) @ p["v"]
    e = np.where(mask > 0, e, -1e9)
    w = np.exp(e - e.max(0)) * mask
    w /= np.maximum(w.sum(0), 1e-9)
    return (w * (states[0] @ o[:hidden] + states[1] @ o[hidden:])).sum(0) + p["bias"][0]


def backward(p: Params, x: np.ndarray, mask: np.ndarray, cache: tuple, dlogit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters but for E, and of x."""
    parts, states, u, w, pooled = cache
    hidden = p["nf"].size
    g: Params = {"o": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * p["o"]
    dw = (states * dpooled).sum(2)
    de = w * (dw - (w * dw).sum(0))
    g["v"] = np.tensordot(de, u, 2)
    du = de[:, :, None] * p["v"] * (1 - u * u)
    g["A"] = np.tensordot(states, du, ((0, 1), (0, 1)))
    ds = w[:, :, None] * dpooled + du @ p["A"].T
    dx = _gru_back(p, "f", x, parts["f"][1], ds[:, :, :hidden], g)
    return g, dx + _gru_back(p, "b", x, parts["b"][1], ds[:, :, hidden:], g)


def embedded(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Half each word's own embedding, half its n-grams' mean."""
    sizes = np.diff(starts, append=len(rows))
    own = table[rows[starts]]
    total = np.add.reduceat(table[rows], starts, axis=0)
    return 0.5 * own + 0.5 * (total - own) / np.maximum(sizes - 1, 1)[:, None].astype(table.dtype)


def inputs_of(p: Params, words: list[bytes]) -> np.ndarray:
    """The network's input of each word."""
    hashes, starts = word_hashes(words)
    parts = [embedded(p["E"], table_rows(hashes, starts, len(p["E"]) // 2), starts), evidences_of(p["L"], hashes, starts)]
    return np.concatenate(parts, axis=1).astype(p["E"].dtype)


def windows(ids: np.ndarray) -> np.ndarray:
    """[n, WINDOW] of word numbers, 0 where there is none; one empty window for no words."""
    n = max(1, -(-(len(ids) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _logits(p: Params, vectors: np.ndarray, wins: np.ndarray, batch: int = 1024) -> np.ndarray:
    out = np.empty(len(wins), np.float64)
    order = np.argsort((wins > 0).sum(1), kind="stable")  # windows of like length together, for shorter steps
    for at in range(0, len(wins), batch):
        pick = order[at : at + batch]
        part = wins[pick]
        part = part[:, : max(1, int((part > 0).sum(1).max()))].T
        out[pick] = infer(p, vectors[part], (part > 0).astype(vectors.dtype))
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, warm: int = 240, rounds: int = 4, steps: int = 40, hidden_words: float = 0.3) -> Params | None:
    """Fit on whole texts with 0/1 labels; None without both labels."""
    labels = np.asarray(labels, np.float64)
    if labels.min(initial=1) == labels.max(initial=0):
        return None
    rng, number = np.random.default_rng(seed), {b"": 0}  # 0 is no word
    ids = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in texts]
    listed, found = list(number), []
    for i in range(0, len(listed), 10_000):
        found.append(word_hashes(listed[i : i + 10_000]))
    before = np.cumsum([0, *(len(h) for h, _ in found)])
    hashes, starts = np.concatenate([h.astype(np.uint32) for h, _ in found]), np.concatenate([s + b for (_, s), b in zip(found, before)])
    del listed, found
    sizes, parts = np.diff(starts, append=len(hashes)), _by_words(starts, len(hashes))
    in_table = lambda size: np.concatenate([table_rows(hashes[h].astype(np.int64), starts[w] - h.start, size).astype(np.int32) for w, h in parts])
    rows, p = in_table(ROWS), init(seed, np.float64)
    # Evidence: documents of either label that hold a row, by fold; folds are dealt within each label.
    fold = np.empty(len(texts), np.int64)
    for y in (0, 1):
        fold[labels == y] = np.arange(int((labels == y).sum())) % FOLDS
    seen, n = np.zeros((FOLDS, 2, 2 * EVIDENCE_ROWS)), np.zeros((FOLDS, 2))
    where = in_table(EVIDENCE_ROWS)
    for f, y, words in zip(fold, labels.astype(int), ids):
        own = np.unique(words)
        at = np.repeat(starts[own], sizes[own]) + np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        seen[f, y, np.unique(where[at])] += 1
        n[f, y] += 1
    p["L"] = evidence_table(seen.sum(0), n.sum(0))
    evidence = np.empty((FOLDS, len(starts), EVIDENCES))
    for f in range(FOLDS):
        table = evidence_table(seen.sum(0) - seen[f], n.sum(0) - n[f])
        for w, h in parts:
            evidence[f, w] = evidences_of(table, hashes[h].astype(np.int64), starts[w] - h.start)
    del seen, where, hashes
    wins = [windows(x).astype(np.int32) for x in ids]
    owner = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    wins = np.concatenate(wins)
    del ids, number
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    halves = [np.flatnonzero(labels[owner] == y) for y in (0, 1)]
    count, own_width = 0, p["E"].shape[1]

    def step(pick: np.ndarray, rate: float) -> None:
        nonlocal count
        count += 1
        part = wins[pick].T
        names, at = np.unique(part, return_inverse=True)
        at = at.reshape(part.shape)
        few = sizes[names]
        firsts = np.cumsum(few) - few
        flat = rows[np.repeat(starts[names] - firsts, few) + np.arange(few.sum())]
        shown = (rng.random((len(names), 1)) >= hidden_words).astype(float)  # the others are known by their evidence alone
        vectors = embedded(p["E"], flat, firsts) * shown
        mask = (part > 0).astype(float)
        x = np.concatenate([vectors[at], evidence[fold[owner[pick]][None, :], part]], axis=2)
        logit, cache = forward(p, x, mask, keep=True)
        g, dx = backward(p, x, mask, cache, (_sigmoid(logit) - labels[owner[pick]]) / len(pick))
        dvectors = np.zeros_like(vectors)
        np.add.at(dvectors, at.ravel(), (dx[:, :, :own_width] * mask[:, :, None]).reshape(-1, own_width))
        dvectors *= shown
        share = np.repeat(0.5 / np.maximum(few - 1, 1), few)
        share[firsts] = 0.5
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], flat, np.repeat(dvectors, few, axis=0) * share[:, None])
        for k, grad in g.items():
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            fix = rate * np.sqrt(1 - 0.99**count) / (1 - 0.9**count)
            p[k] = p[k] - fix * m / (np.sqrt(v) + 1e-6)

    def best() -> tuple[np.ndarray, np.ndarray]:
        """The highest window of each document and its logit, by the evidence of the other folds."""
        logit, vectors = np.empty(len(wins)), np.concatenate([embedded(p["E"], rows[h], starts[w] - h.start) for w, h in parts])
        for f in range(FOLDS):
            mine = np.flatnonzero(fold[owner] == f)
            if len(mine):
                logit[mine] = _logits(p, np.concatenate([vectors, evidence[f]], axis=1), wins[mine])
        order = np.lexsort((logit, owner))
        last = np.flatnonzero(np.diff(owner[order], append=-1))
        return order[last], logit[order[last]]

    for _ in range(warm):
        step(np.concatenate([rng.choice(h, 48) for h in halves]), 0.01)
    docs = [np.flatnonzero(labels == y) for y in (0, 1)]
    for _ in range(rounds):
        top = best()[0]
        for _ in range(steps):
            step(np.concatenate([top[rng.choice(d, 32)] for d in docs] + [rng.choice(halves[0], 16)]), 0.005)
    # Move the best cut between the labels, by balanced accuracy and widest gap, to 0.
    logit = best()[1]
    order = np.argsort(logit, kind="stable")
    sorted_, y = logit[order], labels[order]
    right = np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum() + np.concatenate([np.cumsum(y[::-1])[::-1], [0]]) / y.sum()
    cuts = np.concatenate([[sorted_[0] - 1], (sorted_[1:] + sorted_[:-1]) / 2, [sorted_[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(sorted_), [0]])
    good = np.flatnonzero(right >= right.max() - 1e-9)
    p["bias"] = p["bias"] - cuts[good[np.argmax(gaps[good])]]
    return {k: x.astype(np.float32) for k, x in p.items()}


def _spread(raw: bytes) -> bytes:
    """At most ``TRAIN_WORDS`` words of a text, in blocks of a window spread evenly over it."""
    words = raw.split()
    if len(words) <= TRAIN_WORDS:
        return raw
    blocks = TRAIN_WORDS // WINDOW
    starts = np.linspace(0, len(words) - WINDOW, blocks).astype(int)
    return b" ".join(w for s in starts for w in words[s : s + WINDOW])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Params | None:
    """Train on a bounded sample: ``docs`` are the documents that may be learned from."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    # A bound on the hash takes about ``per_label`` of a label; nothing is put in order.
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    bound = F.when(F.col("toxic") == 1, per_label / max(1, n.get(1, 0))).otherwise(per_label / max(1, n.get(0, 0)))
    picked = known.where(u < bound)
    sample = docs.where(fold() != 0).select("doc_id", utf8("text").alias("raw")).join(F.broadcast(picked), "doc_id")  # some 2 * per_label rows

    def short(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "raw": [_spread(x) for x in batch.column("raw").to_pylist()]}

    short_rows = map_arrow(sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "raw"), "doc_id long, toxic int, raw binary", short).distinct()
    rows = sorted((r.doc_id, bytes(r.raw), r.toxic) for r in short_rows.collect())
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.float64))


class Scorer:
    def __init__(self, params: Params):
        self.p, self.number, self.vectors = params, {}, np.zeros((1, params["E"].shape[1] + EVIDENCES), np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text: its highest window's."""
        split = [t.split() for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.number))
        if len(self.number) + len(new) > _CACHE:
            self.number, self.vectors = {}, self.vectors[:1]
            new = list(dict.fromkeys(w for words in split for w in words))
        if new:
            self.number.update((w, i) for i, w in enumerate(new, len(self.vectors)))
            parts = [inputs_of(self.p, new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.vectors = np.concatenate([self.vectors, *parts])
        number = self.number
        wins = [windows(np.array([number[w] for w in words], np.int64)) for words in split]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in wins])[:-1]]).astype(np.int64)
        return _sigmoid(np.maximum.reduceat(_logits(self.p, self.vectors, np.concatenate(wins)), starts)) if wins else np.empty(0)


_scorer: list = [None, None]


def score(docs: DataFrame, params: Params | None) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(params)  # some 300,000 floats

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("raw").to_pylist()
        if shared.value is None:
            scores = np.zeros(len(texts))
        else:
            if _scorer[0] is not shared.value:
                _scorer[:] = shared.value, Scorer(shared.value)
            scores = _scorer[1](texts)
        return {"doc_id": batch.column("doc_id"), "score": pa.array(scores.astype(np.float64)), "predicted": pa.array((scores >= 0.5).astype(np.int32))}

    return map_arrow(docs.select("doc_id", utf8("text").alias("raw")), "doc_id long, score double, predicted int", run, 512)
