"""One query for each operator, over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, byte_bpe, language_id, line_dedup, mixing, quality, simhash, token_files, toxicity, warc
from ._common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.withColumn("held_out", toxicity.fold() == 0)


def op5_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(_table(spark, sf_dir, "embeddings"), lambda: F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs.where(language_id.fold() != 1)))
    return found.withColumn("held_out", language_id.fold() == 1)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), payloads=False).drop("url")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return byte_bpe.digest(coded)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_token_files": op2_token_files,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_ann_tree": op5_ann_tree,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_warc": op8_warc,
        "op9_simhash": op9_simhash,
        "op10_byte_bpe": op10_byte_bpe,
    }


_OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS weight, CAST(3 * source_size AS DOUBLE) / ((place - 1) % 3 + 1) AS ratio FROM s),
l AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT arg_min(level, (ratio, place)) AS final FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(weight * final, 0.0::DOUBLE)) AS target FROM l, f),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
b AS (SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS hex, first FROM p JOIN f ON p.html = f.html),
x AS (SELECT page_id, i, list_sum([CAST(strpos('0123456789abcdef', hex[10 * i + j]) - 1 AS BIGINT) << (4 * (10 - j)) FOR j IN range(1, 11)])::BIGINT AS v
      FROM b, range(4) AS r(i)),
g AS (SELECT page_id, string_agg(array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (35 - 5 * k)) & 31)::INT + 1, 1) FOR k IN range(8)], ''), '' ORDER BY i) AS payload_digest
      FROM x GROUP BY page_id)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN g USING (page_id)
"""


#: The order of the prefix is by count and word, not by hashed class: another order, the same join.
_OP6_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)
           WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, i, list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
s AS (SELECT ws, min((doc_id, i)) AS pos FROM w WHERE len(ws) > 0 GROUP BY ws),
k AS (SELECT row_number() OVER (ORDER BY pos) AS id, ws, len(ws) AS n FROM s),
t AS (SELECT id, n, unnest(ws) AS token FROM k),
f AS (SELECT token, count(*) AS c FROM t GROUP BY token),
o AS (SELECT id, n, t.token, row_number() OVER (PARTITION BY id ORDER BY c, t.token) AS j FROM t JOIN f ON t.token = f.token),
p AS (SELECT id, n, token FROM o WHERE j <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.id AS x, y.id AS y FROM p x JOIN p y ON x.token = y.token AND y.id < x.id AND 5 * y.n >= 4 * x.n AND 5 * x.n >= 4 * y.n),
g AS (SELECT DISTINCT x FROM c JOIN k a ON a.id = c.x JOIN k b ON b.id = c.y WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
m AS (SELECT w.doc_id, w.i FROM w JOIN s ON w.ws = s.ws JOIN k ON k.ws = s.ws WHERE (w.doc_id, w.i) > s.pos OR k.id IN (SELECT x FROM g)),
r AS (SELECT doc_id, count(DISTINCT i) AS n_removed, array_to_string(list_sort(list(DISTINCT i)), ',') AS removed FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1_SQL, "op6_line_dedup": _OP6_SQL, "op8_warc": _OP8_SQL}
