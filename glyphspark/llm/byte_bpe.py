"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merges come from a rank file (base64 token, rank). Text is cut by a pattern, each match is
encoded on its own, special tokens are ordinary text. Decoding looks ids up in the byte table and
joins the bytes, so characters split over several tokens come back whole.

Nulls and empty texts encode to no ids and decode to no bytes. Rows are independent: ties, repeated
rows and long texts need no care, and an empty table gives an empty one. Only ``doc_id`` and the text
column are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, utf8

#: Inside a text, a match never holds a non-blank followed by a blank, and a lone space goes to what
#: follows it: cutting there leaves every match whole. (Python's blanks include all of the pattern's.)
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Two matches of the pattern in a row: letters after a lone space or none, then marks or none.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
#: Entries of a worker's memory of encoded pieces; beyond it the memory starts anew.
_CACHE = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + spare))
        spare += b not in plain
    return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.sizes = np.array([len(t) for t in self.table], np.int64)
        letters = byte_alphabet()
        shown = lambda token: "".join(letters[b] for b in token)
        # Whatever two tokens make up a token may merge into it, at that token's rank.
        merges = [
            (shown(t[:i]), shown(t[i:])) for t in self.table for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.letters, self.plain = dict(enumerate(letters)), pattern == PATTERN

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece of letters and marks by the model alone, without the splitter; None for others."""
        if not self.plain or not (m := _PLAIN.fullmatch(piece)):
            return None
        shown = m[1]
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.letters)
        elif shown[0] == " ":
            shown = self.letters[32] + shown[1:]
        if m[2] not in self.marks:
            self.marks[m[2]] = np.array(self.tokenizer.encode(m[2], add_special_tokens=False).ids, "<i4").tobytes()
        return array("i", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes() + self.marks[m[2]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text (int32)."""
        head, *rest = _SAFE_CUT.split(text)
        pieces = [head, *(" " + x for x in rest)]
        known = self.known
        if new := {p for p in pieces if p not in known}:
            if len(known) + len(new) > _CACHE:
                known.clear()
                new = set(pieces)
            known.update((p, ids) for p in new if (ids := self._piece(p)) is not None)
            todo = [p for p in new if p not in known]
            for p, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<i4").tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), "<i4")

    def decode(self, ids) -> bytes:
        """Bytes of the ids; a character that several ids share is whole again here."""
        table = self.table
        return b"".join([table[i] for i in ids])

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end character of each id; ids that share a character all point at it."""
        ends = np.cumsum(self.sizes[ids])
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        char_of_byte = np.cumsum(lead) - 1
        return char_of_byte[ends - self.sizes[ids]], char_of_byte[ends - 1] + 1


@functools.lru_cache(maxsize=4)
def _coder(rank_path: str, pattern: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteBpe(rank_path, pattern)


def encode_decode(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", with_offsets: bool = True, text_out: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (bytes of the decoded ids); starts and ends of the ids, in
    characters, if ``with_offsets``; decoded_text if ``text_out``."""

    def run(batch: pa.RecordBatch) -> dict:
        coder = _coder(rank_path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids": [], "decoded": [], "starts": [], "ends": []}
        for raw in batch.column("raw").to_pylist():
            ids = coder.encode(whole := raw.decode("utf-8", "replace"))
            out["n_tokens"].append(len(ids))
            out["ids"].append(ids)
            out["decoded"].append(coder.decode(ids.tolist()))
            if with_offsets:
                starts, ends = coder.offsets(whole.encode(), ids) if len(ids) else (ids, ids)
                out["starts"].append(starts.astype(np.int32))
                out["ends"].append(ends.astype(np.int32))
        for name in ("ids", "starts", "ends"):
            flat = np.concatenate(out[name]) if out[name] else np.empty(0, np.int32)
            ends_ = np.cumsum([0, *map(len, out[name])]).astype(np.int32)
            out[name] = pa.ListArray.from_arrays(pa.array(ends_), pa.array(flat.astype(np.int32)))
        return out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_tokens long, ids array<int>, decoded binary"
    if with_offsets:
        schema += ", starts array<int>, ends array<int>"
    out = map_arrow(docs.select("doc_id", utf8(text).alias("raw")), schema, run, 64)
    return out.withColumn("decoded_text", F.col("decoded").cast("string")) if text_out else out


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids in decimal, joined by a space, and of the decoded bytes."""
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", "n_tokens", F.sha2(shown.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
