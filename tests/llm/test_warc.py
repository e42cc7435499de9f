import base64
import gzip
import hashlib
import io
import zlib

import pytest

from glyphspark.llm import warc

PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://e/", "x" * 700_000), (0, "http://f/", "<p>é</p>"), (0, "http://f/", "<p>é</p>"), (None, "http://g/", "solo")]


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, raw string")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(rows) == len(PAGES)
    text = {p[0]: p[2] for p in PAGES}
    for r in rows:
        assert r.payload_bytes == len((text[r.page_id] or "").encode()) and r.payload_digest == _digest(text[r.page_id])
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert r.payload.decode() == (text[r.page_id] or "")
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds == {0: ("response", None), 1: ("revisit", 0), 2: ("revisit", 0), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), None: ("response", None)}
    few = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, min_bytes=1)).collect()}
    assert few[4] == "response" and few[1] == "revisit"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_records_are_single_gzip_members_and_verified():
    one, two = warc.record(1, "http://a/", b"hello", None), warc.record(2, "http://b/", b"hello", 1)
    assert [len(gzip.decompress(x)) for x in (one, two)] == [len(b"".join(x)) for x in warc.members(io.BytesIO(one + two))]
    found = list(warc.read_records(io.BytesIO(one + two)))
    assert [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in found] == [(1, "response", 5), (2, "revisit", 5)]
    plain = gzip.decompress(one)
    for broken in (plain.replace(b"hello", b"jello"), plain[:-2], plain.replace(b"WARC/1.1", b"HTTP/1.1", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(one[:-12])))


def test_a_member_cut_anywhere_is_an_error():
    one, two = warc.record(1, "http://a/", b"hello" * 50, None), warc.record(2, "http://b/", b"x" * 40_000, None)
    assert list(warc.read_records(io.BytesIO(b""))) == []
    for cut in [*range(1, len(two)), -1]:
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(one + two[:cut])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(io.BytesIO(one + b"no gzip member at all")))


def test_long_pages_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "_READ", 100)
    monkeypatch.setattr(warc, "_STEP", 7)
    body = bytes(range(256)) * 2000 + b"\r\n\r\n" * 5
    data = warc.record(1, "http://a/", body, None) + warc.record(2, "http://b/", body, 1) + warc.record(None, "", b"", None)
    rows = list(warc.read_records(io.BytesIO(data)))
    assert [r["payload"] for r in rows] == [body, None, b""] and [r["payload_bytes"] for r in rows] == [len(body), len(body), 0]
    bare = list(warc.read_records(io.BytesIO(data), payloads=False))
    assert [{**r, "payload": None} for r in rows] == bare
