"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of target and raw corpus.

Texts are read as hashed byte n-grams. One multinomial is counted over all documents (raw corpus),
another over trusted documents (labelled quality 1), the latter smoothed towards the former. A
document's score is the sum of log(target / raw) over all its n-grams, divided by their number plus
``SHRINK``; it is kept if it passes the base rules and its score is at least ``THRESHOLD``. No chance
is involved: equal texts get equal verdicts.

A null or empty text has no words and fails the base rules; very long texts are read whole. Rows are
independent, so ties and repeated rows need no care (a score equal to the threshold is kept, trusted
documents of equal hashes follow in the order of their ids); an empty table gives an empty one; without trusted rows the target equals the raw
corpus and only the base rules speak. Columns other than doc_id and text are not looked at, whatever
their names; ``keep_good`` passes them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, slices, utf8

ORDER = 4
BUCKETS = 1 << 16
#: Trusted documents that the target is counted on: those of the smallest hashes, at most so many.
MAX_TRUSTED = 20_000
#: Weight, in n-grams, of the raw corpus in the smoothed target.
PRIOR = 20_000
SHRINK = 100
THRESHOLD = -0.3
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
_WINDOW = 8


def ngram_buckets(raw: bytes) -> np.ndarray:
    """Bucket of every byte n-gram (of the one short n-gram, if the text is shorter)."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if not len(b):
        return b
    if len(b) < ORDER:
        b = np.pad(b, (0, ORDER - len(b)))
    n = len(b) - ORDER + 1
    h = np.zeros(n, np.uint32)
    for i in range(ORDER):
        h = h * np.uint32(0x01000193) + b[i : i + n] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BUCKETS.bit_length() + 1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words which the text holds twice or more."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(_WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    views = np.lib.stride_tricks.sliding_window_view(ids, _WINDOW)
    same = same[(views[order[same]] == views[order[same + 1]]).all(axis=1)]
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.union1d(order[same], order[same + 1])
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + _WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, _BLANKS))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def fit(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log(target / raw) of each bucket. Raw counts cover all of ``docs``."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(True))
    marked = docs.select("doc_id", utf8("text").alias("raw")).join(F.broadcast(trusted), "doc_id", "left").select("raw", "trusted")
    schema = pa.schema([("bucket", pa.int32()), ("n_raw", pa.int64()), ("n_target", pa.int64())])

    def count(batches):
        both = np.zeros((2, BUCKETS), np.int64)
        for part in slices(batches):
            texts, flags = part.column(0).to_pylist(), part.column(1).to_pylist()
            for row, pick in ((0, texts), (1, [t for t, f in zip(texts, flags, strict=True) if f])):
                if pick:
                    both[row] += np.bincount(np.concatenate([ngram_buckets(t) for t in pick]), minlength=BUCKETS)
        used = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(both[0][used]), pa.array(both[1][used])], schema=schema)

    counts = marked.mapInArrow(count, "bucket int, n_raw long, n_target long").groupBy("bucket")
    n = np.zeros((2, BUCKETS))
    for r in counts.agg(F.sum("n_raw"), F.sum("n_target")).collect():  # at most BUCKETS rows
        n[:, r[0]] = r[1:]
    raw = (n[0] + 1) / (n[0].sum() + BUCKETS)
    target = (n[1] + PRIOR * raw) / (n[1].sum() + PRIOR)
    return np.log(target / raw)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score (mean log-likelihood ratio) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles

    def run(batch: pa.RecordBatch) -> dict:
        ratio, counts, scores = shared.value, [], []
        for raw in batch.column("raw").to_pylist():
            counts.append(base_counts(raw))
            grams = ngram_buckets(raw)
            scores.append(float(ratio[grams].sum()) / (len(grams) + SHRINK))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        cols = dict(zip(names, zip(*counts, strict=True), strict=True)) if counts else {k: [] for k in names}
        failed = [n < 20 or 100 * rep > 30 * n for n, _, _, _, rep in counts]
        kept = [not f and s >= threshold for f, s in zip(failed, scores, strict=True)]
        return cols | {"doc_id": batch.column("doc_id"), "base_failed": failed, "score": scores, "kept": kept}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return map_arrow(docs.select("doc_id", utf8("text").alias("raw")), schema, run)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, every column unchanged; fitted on ``docs`` itself."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):  # Python objects of few texts live at a time
            for raw in texts.slice(at, 256).to_pylist():
                n, _, _, _, rep = base_counts(raw)
                grams = ngram_buckets(raw)
                score = float(shared.value[grams].sum()) / (len(grams) + SHRINK)
                out.append(n >= 20 and 100 * rep <= 30 * n and score >= threshold)
        return pa.array(out, pa.bool_())

    return docs.where(passes(utf8("text")))
