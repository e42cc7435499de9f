"""Language identification by compression.

Each language has a raw-content dictionary: its words of the highest document counts, the commonest
last (nearest to the text). A text is reduced to lower-case letters and blanks, cut in pieces, and each
piece is compressed with every dictionary; the language of the smallest total wins, ties going to the
smaller name. The score is a soft share of the winner; ``rejected`` marks narrow margins.

A text that is null or has no letter (Unicode category L; digits, fractions and Roman numeral signs are
none) is ``und`` with score 0, as is every text if nothing was learned. Very long texts are scored whole, in
pieces; a word too long for a dictionary is in none. Texts are scored alone, so repeated rows score alike,
and equal rows are learned from once; an empty table gives an empty one. Only doc_id, text and (for
learning) lang are read, so extra columns do no harm, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, utf8

#: Labelled documents that dictionaries are made from: about so many of a language and in all, those whose
#: hashes are below a bound that follows from the language's number of documents.
SAMPLE_PER_LANGUAGE, SAMPLE = 2_000, 200_000
DICTIONARY_BYTES = 32_000
PIECE_BYTES = 1_000
LEVEL = 6
#: A text is rejected if its score is below this.
NARROW = 0.6
#: Parts in which a language's words are ranked before all of them are.
_PARTS = 64
_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def letters_only(text: str) -> bytes:
    """Lower-case letters (with their marks) and single blanks; blanks alone if there is no letter."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode() if _LETTER.search(text) else b" "


def fold(doc_id: str = "doc_id", mod: int = 3) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of every language in ``docs`` (training rows only are to be passed)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    key = F.xxhash64("doc_id", "text")
    sizes = [tuple(r) for r in known.groupBy("lang").agg(F.approx_count_distinct(key, 0.02).alias("n")).collect()]  # a row for each language
    if not sizes:
        return {}
    wanted = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE // len(sizes)))
    bounds = docs.sparkSession.createDataFrame([(lang, wanted / max(1, n)) for lang, n in sizes], "lang string, bound double")
    u = F.shiftrightunsigned(key, 11) / float(1 << 53)
    sample = known.withColumn("_u", u).join(F.broadcast(bounds), "lang").where("_u < bound").select("lang", utf8("text").alias("raw")).distinct()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "word": []}
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            words = sorted(set(letters_only(raw.decode("utf-8", "replace")).decode().split()))
            out["lang"] += [lang] * len(words)
            out["word"] += words
        return out

    counts = map_arrow(sample, "lang string, word string", run).where(F.octet_length("word") < DICTIONARY_BYTES).groupBy("lang", "word").count()
    # The first words of each part of a language hold the first of all; so no task ranks all its words.
    order = [F.desc("count"), F.col("word").asc()]
    most, part = DICTIONARY_BYTES // 2, F.pmod(F.xxhash64("word"), F.lit(_PARTS)).alias("_part")
    parts = counts.withColumn("_part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("at") <= most)
    top = parts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= most).orderBy("lang", "at")
    chosen: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for r in top.select("lang", "word").toLocalIterator():  # DICTIONARY_BYTES / 2 words of a language at most
        word = r.word.encode()
        if room.setdefault(r.lang, DICTIONARY_BYTES) > len(word):
            chosen.setdefault(r.lang, []).append(word)
            room[r.lang] -= len(word) + 1
    return {lang: b" " + b" ".join(words[::-1]) + b" " for lang, words in sorted(chosen.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.packers = {
            lang: z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
            for lang, d in dictionaries.items()
        }

    def __call__(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow."""
        plain = letters_only(text)
        if not self.packers or not plain.strip():
            return "und", 0.0, True
        pieces = [plain[i : i + PIECE_BYTES] for i in range(0, len(plain), PIECE_BYTES)]
        sizes = {lang: sum(len(c.compress(p)) for p in pieces) for lang, c in self.packers.items()}
        best = min(sizes, key=lambda lang: (sizes[lang], lang))
        scale = 1 + 0.02 * sizes[best]
        score = 1 / sum(2.718281828459045 ** ((sizes[best] - s) / scale) for s in sizes.values())
        return best, score, score < NARROW


_made: dict[int, Classifier] = {}


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batch: pa.RecordBatch) -> dict:
        key = hash(tuple(shared.value.items()))
        if key not in _made:
            _made.clear()
            _made[key] = Classifier(shared.value)
        found = [_made[key](raw.decode("utf-8", "replace")) for raw in batch.column("raw").to_pylist()]
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return {"doc_id": batch.column("doc_id"), "lang_pred": list(cols[0]), "score": list(cols[1]), "rejected": list(cols[2])}

    return map_arrow(docs.select("doc_id", utf8("text").alias("raw")), "doc_id long, lang_pred string, score double, rejected boolean", run)
