"""The registered coding keeps the method's offsets."""

import corpus_pipeline
import pytest

from glyphspark.llm import byte_bpe
from glyphspark.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", [False, True])
def test_coding_computes_offsets(spark, monkeypatch, stage):
    seen, digest = [], byte_bpe.digest
    monkeypatch.setattr(byte_bpe, "digest", lambda coded: seen.append(coded) or digest(coded))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    out = corpus_pipeline.byte_bpe_coding(spark, docs, SF) if stage else llm.op10_byte_bpe(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = seen[0].limit(5).collect()
    assert rows and all(len(r.starts) == len(r.ends) == r.n_tokens for r in rows)
