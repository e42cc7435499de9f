"""WARC archives: writing pages and a sequential reader.

Each record is one gzip member. The reader inflates incrementally, finds the ends of members by the
inflater's leftover, frames records by Content-Length and verifies block and payload digests as the bytes
go by. It holds a record's headers and, if payloads are wanted, the payload; a record that is cut off, runs
on or does not match its digests is an error, wherever the file ends.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id (nulls
last) is a response and the others are revisits, whose records hold the HTTP headers (with the full
payload's length) but no payload. Rows that repeat the smallest page_id are all responses. A null html
is an empty payload; very long ones are written whole. Smaller payloads are always responses. An empty
table gives no archive and no row. Only page_id, url and html are read, whatever other columns are named; a
null url is written as an empty target.

Payloads are compared by SHA-1 and length. Pages are spread over files by page hash, so one very
frequent page does not fill one file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, slices, stored, utf8
from .token_files import _filesystem, task_count

_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pieces that one digest's pages are spread over in the join with the table of repeated digests.
_SALTS = 32
#: Bytes read at once, bytes inflated at once, bytes that headers may have.
_READ, _STEP, _HEADERS = 1 << 18, 1 << 14, 1 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member with a response record, or a revisit one if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + _CRLF + _CRLF) + packer.flush()


def members(f) -> Iterator[Iterator[bytes]]:
    """Plain bytes of each gzip member of a file object, in pieces; a member is to be read to its end
    before the next one."""
    inflater, fed = zlib.decompressobj(31), False

    def pieces(rest: bytes) -> Iterator[bytes]:
        nonlocal inflater, fed, left
        while True:
            for at in range(0, len(rest), _STEP):  # small steps: what follows a member is copied
                fed = True
                plain = inflater.decompress(rest[at : at + _STEP])
                if plain:
                    yield plain
                if inflater.eof:
                    left = inflater.unused_data + rest[at + _STEP :]
                    inflater, fed = zlib.decompressobj(31), False
                    return
            rest = f.read(_READ)
            if not rest:
                raise ValueError("the last gzip member is cut off")

    left = f.read(_READ)
    while left:
        yield pieces(left)
        if fed:
            raise ValueError("a member was left before its end")
        left = left or f.read(_READ)


class Record:
    """A record, fed with its bytes in pieces."""

    def __init__(self, hold: bool):
        self.hold, self.fields, self.http = hold, None, None
        self.head, self.body, self.kept, self.left = bytearray(), bytearray(), [], 0
        self.block, self.payload, self.payload_bytes = hashlib.sha1(), hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(_CRLF + _CRLF)
            if end < 0:
                if len(self.head) > _HEADERS or not b"WARC/1.".startswith(self.head[:7]):
                    raise ValueError("not a WARC record")
                return
            lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            self.left = int(self.fields["content-length"])
            data, self.head = bytes(self.head[end + 4 :]), bytearray()
        block, after = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block.update(block)
        if self.http is None:
            self.body += block
            end = self.body.find(_CRLF + _CRLF)
            if end < 0:
                if len(self.body) > _HEADERS:
                    raise ValueError("no end of the HTTP headers")
                block = b""
            else:
                self.http, block, self.body = bytes(self.body[:end]), bytes(self.body[end + 4 :]), bytearray()
        self.payload.update(block)
        self.payload_bytes += len(block)
        if self.hold and block:
            self.kept.append(block)
        self.head += after
        if len(self.head) > 4:
            raise ValueError("the record does not end where its Content-Length says")

    def row(self) -> dict:
        """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to, once all is fed."""
        if self.fields is None or self.left or self.head != _CRLF + _CRLF:
            raise ValueError("the record does not end where its Content-Length says")
        shown = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        fields, number = self.fields, lambda k: int(self.fields[k]) if self.fields.get(k) else None
        if fields.get("warc-block-digest", shown(self.block)) != shown(self.block):
            raise ValueError("the block does not match its digest")
        stated, kind, size, payload = fields["warc-payload-digest"], fields["warc-type"], self.payload_bytes, None
        if kind == "revisit":
            size = next(int(x.split(b":")[1]) for x in (self.http or b"").split(_CRLF) if x.lower().startswith(b"content-length:"))
        elif shown(self.payload) != stated:
            raise ValueError("the payload does not match its digest")
        elif self.hold:
            payload = b"".join(self.kept)
        return {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": size,
                "payload_digest": stated.removeprefix("sha1:"), "record_type": kind, "refers_to": number("x-refers-to-page-id")}


def read_records(f, payloads: bool = True) -> Iterator[dict]:
    """A row (see ``Record.row``) for each record, in file order."""
    for pieces in members(f):
        record = Record(payloads)
        for piece in pieces:
            record.feed(piece)
        yield record.row()


def write_archives(pages: DataFrame, out_uri: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all pages; returns the stored manifest: path, n_records."""
    spark = pages.sparkSession
    out_uri = (out_uri or fresh_path(spark, "warc")).rstrip("/")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), utf8("html").alias("raw"))
    rows = rows.withColumns({"_sha": F.sha1("raw"), "_size": F.octet_length("raw"), "_salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")})
    # Most payloads occur once; the table of the others is small, and each of its rows meets every salt.
    repeated = rows.where(F.col("_size") >= min_bytes).groupBy("_sha", "_size").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = repeated.where("_n > 1").select("_sha", "_size", "_first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    typed = rows.join(repeated, ["_sha", "_size", "_salt"], "left").select("page_id", "url", "raw", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = (row for b in slices(batches, 64) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(found, None)
        if first is None:
            return
        task = TaskContext.get()
        fs, base = _filesystem(out_uri)
        fs.create_dir(base, recursive=True)
        path = f"{base}/pages-{task.partitionId():08d}.warc.gz"
        mine, n = f"{path}.{task.taskAttemptId()}.part", 0
        with fs.open_output_stream(mine) as f:
            for part in ([first], found):
                for page_id, url, raw, refers_to in part:
                    f.write(record(page_id, url, raw, refers_to))
                    n += 1
        fs.move(mine, path)
        yield pa.RecordBatch.from_pylist([{"path": f"{out_uri}/{path.rpartition('/')[2]}", "n_records": n}])

    # One short row for each file: gathered, so that the manifest is not as many files again.
    return stored(typed.mapInArrow(run, "path string, n_records long").repartition(1), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives that the manifest names."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([x for x in fields if payloads or x[0] != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _filesystem(path)
                with fs.open_input_stream(inner, compression=None) as f:
                    held: list[dict] = []
                    for r in read_records(f, payloads):
                        held.append(r)
                        if len(held) == 64:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    names = {"int64": "long", "string": "string", "binary": "binary"}
    # A number of its own: the manifest is small, but each of its rows is a file to read.
    return manifest.select("path").repartition(task_count(manifest, F.col("n_records") * 1024)).mapInArrow(run, ", ".join(f"{x.name} {names[str(x.type)]}" for x in schema))
