import hashlib
import random

import corpus_pipeline
from _data import SCHEMA

from glyphspark.llm import mixing


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(120):
        lines = [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(3)]
        rows.append((i, "\n".join(lines), "en", rng.choice("abc"), 1))
        labels.append((i, 1, 0))
    rows += [(200 + i, rows[i][1], "en", "a", 1) for i in range(10)]  # copies
    rows += [(300, "*** ### $$$ " * 30, "en", "a", 1), (301, None, None, None, None), (302, "too short", "en", "b", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r[0] for r in rows if r[0] < 300}
    thin = corpus_pipeline.line_deduplication(spark, good, str(tmp_path))
    texts = {r.doc_id: r.text for r in thin.collect()}
    assert all(texts[200 + i] == "" for i in range(10)) and all(texts[i] == rows[i][1] for i in range(120))
    single = corpus_pipeline.near_deduplication(spark, thin, str(tmp_path))
    kept = sorted(r.doc_id for r in single.collect())
    assert kept == [*range(120), 200]
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(single).collect()}
    want = sorted((i, hashlib.sha256((texts[i] or "").encode()).hexdigest()) for i, n in plan.items() for _ in range(n))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_deduplication", "near_deduplication", "source_mixing", "byte_bpe_coding"]


def test_run_takes_empty_tables_repeated_ids_and_clashing_names(spark, tmp_path):
    schema = SCHEMA + ", size string, pos string, fp string, _row string, h string"
    text = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(4))
    rows = [(i, text(i), "en", "a", 1, "s", "p", "f", "r", "h") for i in range(30)]
    rows += [rows[3], rows[3], (4, text(99), "en", None, 1, "s", "p", "f", "r", "h"), (None, text(77), None, "b", 1, *"spfrh"), (5, None, None, None, None, *"spfrh"), (6, "", "en", "a", 0, *"spfrh")]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/some/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept = docs if name == "near_deduplication" else kept
        docs.write.parquet(f"{tmp_path}/some/{name}")
        docs = spark.read.parquet(f"{tmp_path}/some/{name}")
    ids = sorted((r.doc_id for r in spark.read.parquet(f"{tmp_path}/some/near_deduplication").collect()), key=str)
    assert ids == sorted([*range(30), 4, None], key=str)
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} <= {*range(30), None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
