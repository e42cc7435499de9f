import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from _data import DOCS, documents

from glyphspark.llm import byte_bpe, mixing, token_files

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_reference_on_random_texts(reference):
    coder, rng = byte_bpe.ByteBpe(RANKS, PATTERN), random.Random(3)
    alphabets = ["ab ", "a", "aA'  \n\t", "étß ", "0123 ", "!*- ", "🙂a é́  \x1c\x85", "the ing", "aÉñßÿÀ .,;!?:'", "'sx 'll  \r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 80)))
        ids = coder.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids.tolist()).decode() == text
        starts, ends = coder.offsets(text.encode(), ids) if len(ids) else ([], [])
        for i, s, e in zip(ids.tolist(), starts, ends):
            assert coder.decode([i]) in text[s:e].encode()


def test_bpe_query_rows(spark, reference):
    got = sorted(map(tuple, byte_bpe.digest(byte_bpe.encode_decode(documents(spark), RANKS, PATTERN)).collect()), key=str)
    want = []
    for doc_id, text, *_ in DOCS:
        ids = reference.encode_ordinary(text or "")
        shown = " ".join(map(str, ids))
        want.append((doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    empty = documents(spark).limit(0)
    assert byte_bpe.digest(byte_bpe.encode_decode(empty, RANKS, PATTERN)).collect() == []


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def _word_ids(text):
    return [*_tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def test_token_files_round_trip(spark):
    manifest = token_files.write_token_files(documents(spark), WORD_BPE, frame_bytes=64)
    rows = token_files.read_token_files(manifest).collect()
    order = sorted(((d, t) for d, t, *_ in DOCS), key=lambda r: (r[0] is None, r[0] or 0))
    want, start = [], 0
    for doc_id, text in order:
        ids = _word_ids(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows if r.doc_id is not None)
    got += [(None, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows if r.doc_id is None]
    assert got == want
    total = manifest.agg({"n_tokens": "sum"}).first()[0]
    assert total == start


def test_token_files_random_access_and_checksums(spark, tmp_path):
    manifest = token_files.write_token_files(documents(spark).coalesce(1), WORD_BPE, out_uri=str(tmp_path / "out"), frame_bytes=64).collect()
    found = {}
    for row in manifest:
        for k, v in token_files.read_documents(row.path, [4, 8]).items():
            found[k] = [x.tolist() for x in v]
    assert found == {4: [_word_ids(DOCS[3][1])], 8: [_word_ids(DOCS[9][1])]}
    path = manifest[0].path.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    with open(path, "rb") as f:
        tokens = token_files.TokenFile(f, len(data))
        assert len(tokens.seek) > 1
        tokens.seek = tokens.seek.copy()
        tokens.seek["sum"][0] ^= 1
        with pytest.raises(ValueError):
            tokens.ids(0)
    assert token_files.read_token_files(token_files.write_token_files(documents(spark).limit(0), WORD_BPE)).collect() == []


def test_words_split_alone_as_in_whole_texts():
    coder, rng = token_files.WordEncoder(WORD_BPE), random.Random(5)
    for _ in range(800):
        text = "".join(rng.choice("aBÉñßÿ .,;!'s 12é́   \n\t'llΣς<|>🙂ﬁ.,") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(coder.encode(text.encode()), coder.dtype).tolist() == _word_ids(text)[:-1]


def test_special_tokens_in_a_text_are_read_as_by_the_library():
    from tokenizers import Tokenizer

    coder, library = token_files.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in ("hello <|endoftext|> world", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext|>\n<|ENDOFTEXT|>", "x <|endof text|>", "<|endoftext|>, <|endoftext|>!"):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text.encode()), coder.dtype).tolist() == want
    assert 49407 in np.frombuffer(coder.encode(b"hello <|endoftext|> world"), coder.dtype).tolist()


def _targets_by_loop(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if target[s] > most * sizes[s]}
        if not over:
            return stopped | target
        stopped |= over


def test_targets_equal_resharing_by_loop(spark):
    rng = random.Random(1)
    for _ in range(12):
        sizes = {rng.choice([None, *"abcdefgé𐀀￿"]): rng.choice([0, 1, 5, 100, 100_000]) for _ in range(rng.randint(1, 9))}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = _targets_by_loop(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (sizes, got, want)


def test_mix_emits_what_the_plan_says(spark, monkeypatch):
    docs = documents(spark)
    plan = mixing.mixing_plan(docs)
    rows = plan.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r.copies <= 3 and abs(r.copies - r.rate) < 1
    size = {(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in DOCS}
    assert {(r.doc_id, r["size"]) for r in rows} == size
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(docs).select("doc_id").collect(), key=str) == sorted(mixed.select("doc_id").collect(), key=str)
    assert sorted(mixing.mixing_plan(docs).collect(), key=str) == sorted(rows, key=str)
    assert mixing.mixing_plan(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_a_source_of_one_repeated_row_meets_its_target(spark):
    rows = [(1, "one two three", "en", "a", 1)] * 900 + [(2, "four five", "en", "b", 1)] * 40 + [(i, "six seven", "en", "b", 1) for i in range(10, 400)]
    docs = documents(spark, rows)
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(rows)
    for source in "ab":
        mine = [r for r in plan if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in mine) - mine[0].target) < 0.1 * mine[0].target
        assert all(abs(r.copies - r.rate) < 1 for r in mine)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    taken = {}
    for r in plan:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    assert sorted(map(str, mixing.mixing_plan(docs).collect())) == sorted(map(str, plan))
