"""Token-id files: independent zstandard frames, a trailing seek table and per-frame checksums.

File layout
    data frames    each an independent zstandard frame with its own content checksum, holding the ids
                   of whole documents (little-endian, 2 bytes an id if the vocabulary allows, else 4)
    index          a skippable frame (magic 0x184D2A5B): zstandard-compressed columns of the
                   documents' ids, null flags, frame numbers, first positions in the frame and lengths
    seek table     the skippable frame of the public seekable format (magic 0x184D2A5E): compressed and
                   plain size and XXH64 (low 32 bits) of each data frame, then the 9-byte footer

Readers take the footer, the seek table and the index from the end of the file and decompress only
the frames of the documents that they want.

Documents are written in ascending doc_id order (nulls last; rows of one doc_id by their text), one
file for each range of a range partitioning on (doc_id, hash of text), so a doc_id with many rows
still spreads. Equal rows are written one after the other. A null or empty text gives the end id alone;
a very long text is one document, in a frame of its own. An empty table gives no file and no row. Only
doc_id and the text column are read, whatever other columns are named. A lost executor's files stay in the shared folder; a
repeated task writes the same bytes and renames them over its name.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh_path, slices, stored, utf8
from .byte_bpe import byte_alphabet

_SKIP_INDEX, _SKIP_SEEK, _SEEKABLE = 0x184D2A5B, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])
#: Entries of a worker's memory of encoded words; beyond it the memory starts anew.
_CACHE = 600_000
#: Letters that lower-casing and NFC map one to one, then marks that split off as one piece.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, so each word stands alone. A special token
    written out in a text is that token, as the library reads it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab().values()) < 65536 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.letters = {i: c for i, c in enumerate(byte_alphabet())}

    def _word(self, word: str) -> bytes | None:
        """Ids of letters and closing marks by the model alone, without the normaliser and the splitter,
        which take longer than the merges; None for other words."""
        if not (m := _PLAIN.fullmatch(word)):
            return None
        shown = m[1].lower()
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.letters)
        if m[2] not in self.marks:
            self.marks[m[2]] = np.array(self.tokenizer.encode(m[2], add_special_tokens=False).ids, self.dtype).tobytes()
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes() + self.marks[m[2]]

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as bytes of ``dtype``. Splitting at ASCII blanks changes no id: normalisation
        and pre-tokenization never look across them."""
        words, known = text.split(), self.known
        if new := {w for w in words if w not in known}:
            if len(known) + len(new) > _CACHE:
                known.clear()
                new = set(words)
            known.update((w, ids) for w in new if (ids := self._word(w.decode("utf-8", "replace"))) is not None)
            todo = [w for w in new if w not in known]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in todo], add_special_tokens=False)
            known.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(todo, found, strict=True))
        return b"".join([known[w] for w in words])


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def write_file(out, docs: Iterable[tuple[int | None, bytes]], width: int, frame_bytes: int) -> tuple[int, int]:
    """Write (doc_id, ids) pairs to a binary file object; returns the number of documents and ids."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
    seek, index, held, size = bytearray(), [], [], 0
    frames = 0

    def flush() -> None:
        nonlocal frames, size
        plain = b"".join(held)
        packed = packer.compress(plain)
        out.write(packed)
        seek.extend(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        frames, size = frames + 1, 0
        held.clear()

    for doc_id, ids in docs:
        if held and size + len(ids) > frame_bytes:
            flush()
        index.append((doc_id or 0, doc_id is None, frames, size // width, len(ids) // width))
        held.append(ids)
        size += len(ids)
    if held:
        flush()
    table = np.array(index, _INDEX)
    columns = b"".join(np.ascontiguousarray(table[c]).tobytes() for c in _INDEX.names)
    body = struct.pack("<IB", len(table), width) + zstandard.ZstdCompressor(level=3, write_checksum=True).compress(columns)
    out.write(struct.pack("<II", _SKIP_INDEX, len(body)) + body)
    seek += struct.pack("<IBI", frames, 0x80, _SEEKABLE)
    out.write(struct.pack("<II", _SKIP_SEEK, len(seek)) + seek)
    return len(table), int(table["n"].sum(dtype=np.int64))


class TokenFile:
    """Random access to one file (a seekable binary file object)."""

    def __init__(self, f, size: int):
        import zstandard

        self.f, self.unpacker = f, zstandard.ZstdDecompressor()
        f.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - 12 * frames
        f.seek(table_at)
        self.seek = np.frombuffer(f.read(12 * frames), np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")]))
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        f.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", f.read(8))
        if magic != _SKIP_INDEX:
            raise ValueError("no document index")
        body = f.read(length)
        n, self.width = struct.unpack_from("<IB", body)
        columns = self.unpacker.decompress(body[5:], max_output_size=n * _INDEX.itemsize)
        self.index, at = np.empty(n, _INDEX), 0
        for name in _INDEX.names:
            kind = _INDEX[name]
            self.index[name] = np.frombuffer(columns, kind, n, at)
            at += n * kind.itemsize
        self.frame_no, self.frame = -1, b""

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in this row of the index, from its frame alone (checksum verified)."""
        import xxhash

        entry = self.index[row]
        if entry["frame"] != self.frame_no:
            no = int(entry["frame"])
            self.f.seek(int(self.starts[no]))
            plain = self.unpacker.decompress(self.f.read(int(self.seek["packed"][no])), max_output_size=int(self.seek["plain"][no]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.seek["sum"][no]:
                raise ValueError(f"frame {no} does not match its checksum")
            self.frame_no, self.frame = no, plain
        kind = np.dtype(f"<u{self.width}")
        return np.frombuffer(self.frame, kind, int(entry["n"]), int(entry["at"]) * self.width)


def _filesystem(uri: str):
    """pyarrow's file system and path of a URI as Spark names it."""
    from pyarrow import fs

    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        if uri.startswith(spark_name):
            uri = name + uri.removeprefix(spark_name)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def write_token_files(
    docs: DataFrame, tokenizer_path: str, out_uri: str | None = None, text: str = "text", end_id: int = 1, frame_bytes: int = 1 << 18
) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in doc_id order.

    Returns the manifest: file_no (ascending with doc_id), path, n_docs, n_tokens. It is stored, so
    reading it again writes nothing.
    """
    spark = docs.sparkSession
    out_uri = (out_uri or fresh_path(spark, "token-files")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        rows = ((i, encoder.encode(raw) + end) for b in slices(batches) for i, raw in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True))
        first = next(rows, None)
        if first is None:
            return
        task = TaskContext.get()
        fs, base = _filesystem(out_uri)
        fs.create_dir(base, recursive=True)
        path = f"{base}/tokens-{task.partitionId():08d}.zst"
        mine = f"{path}.{task.taskAttemptId()}.part"
        with fs.open_output_stream(mine) as f:
            n_docs, n_tokens = write_file(f, (r for part in ([first], rows) for r in part), encoder.dtype.itemsize, frame_bytes)
        fs.move(mine, path)
        name = f"{out_uri}/{path.rpartition('/')[2]}"
        yield pa.RecordBatch.from_pylist([{"file_no": task.partitionId(), "path": name, "n_docs": n_docs, "n_tokens": n_tokens}])

    in_order = (
        docs.select("doc_id", utf8(text).alias("raw"))
        .repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("raw"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("raw"), "raw")
    )
    # One short row for each file: gathered, so that the manifest is not as many files again.
    return stored(in_order.mapInArrow(run, "file_no long, path string, n_docs long, n_tokens long").repartition(1), "token-manifest")


def task_count(manifest: DataFrame, size: str | Column) -> int:
    """Tasks that read the files of a manifest: no more than files, no fewer than cores or than a task for
    every 32 million of ``size``."""
    files, total = manifest.agg(F.count(F.lit(1)), F.sum(size)).first()
    return max(1, min(files, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, (total or 0) >> 25)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 4-byte ids). A file is a
    task's; of a file the tables and a few documents are held at a time."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))  # one row for each file: the sizes, not the documents
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = _filesystem(path)
                with fs.open_input_file(inner) as f:
                    tokens = TokenFile(f, f.size())
                    starts = base + np.concatenate([[0], np.cumsum(tokens.index["n"], dtype=np.int64)])
                    for at in range(0, len(tokens.index), 512):
                        part = tokens.index[at : at + 512]
                        ids = [tokens.ids(at + i).astype("<u4").tobytes() for i in range(len(part))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], mask=part["null"] > 0), pa.array(starts[at : at + len(part)]), pa.array(part["n"].astype(np.int64)), pa.array(ids, pa.binary())],
                            schema=schema,
                        )

    # A number of its own: the manifest is small, but each of its rows is a file to read.
    return files.repartition(task_count(manifest, "n_tokens")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """Ids of some documents of one file; other frames stay packed."""
    fs, inner = _filesystem(path)
    with fs.open_input_file(inner) as f:
        tokens = TokenFile(f, f.size())
        wanted = np.flatnonzero(np.isin(tokens.index["doc_id"], list(doc_ids)) & (tokens.index["null"] == 0))
        out: dict[int, list[np.ndarray]] = {}
        for row in wanted:
            out.setdefault(int(tokens.index["doc_id"][row]), []).append(tokens.ids(int(row)))
        return out
