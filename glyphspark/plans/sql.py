"""The same queries in DuckDB's SQL, built from shared common table expressions."""

from __future__ import annotations

# The published character sets, as SQL lists.
_NL = ", ".join("'" + c.replace("'", "''") + "'" for c in ",.;:?!'\"()[]{}")
_KIND = rf"CASE WHEN ch IN ({_NL}) THEN 'structural' WHEN ch IN (' ', chr(10), chr(9)) THEN 'ambiguous' WHEN regexp_matches(ch, '^[\p{{L}}\p{{Nd}}]$') THEN 'lexical' ELSE 'other' END"
_LETTERS = "regexp_matches(ch, '^[a-zA-Z]$')"
_CODE = ", ".join("'" + c + "'" for c in "()[]{},:;=.@+-*/%&|^~<>!?")
KINDS = {
    "nl": _KIND,
    "code_identity": rf"CASE WHEN ch IN ({_CODE}) THEN 'structural' WHEN regexp_matches(ch, '^[\p{{L}}\p{{Nd}}_]$') THEN 'lexical' ELSE 'other' END",
    "ascii_alnum_space": f"CASE WHEN ch IN ({_NL}) THEN 'structural' WHEN regexp_matches(ch, '^[a-zA-Z0-9 ]$') THEN 'lexical' ELSE 'other' END",
    "ascii_letters": f"CASE WHEN ch IN ({_NL}) THEN 'structural' WHEN {_LETTERS} THEN 'lexical' ELSE 'other' END",
}
ALL = "SELECT 'all' AS corpus, doc_id, text || chr(10) AS text FROM documents WHERE text IS NOT NULL"
PAGES = "SELECT 'pages' AS corpus, page_id AS doc_id, html || chr(10) AS text FROM pages WHERE html IS NOT NULL"
LANGS = "SELECT lang AS corpus, doc_id, text || chr(10) AS text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"


def base(source: str = ALL, k: int = 8, kind: str = "nl", test: str = "last", cap: int | None = 5000, rotation: int = 0) -> str:
    """CTEs: chars, b (bounds), parts, ng, tot, occ (test occurrences with surprisal terms)."""
    lags = " || ".join(f"coalesce(lag(ch, {i}) OVER w, '')" for i in range(k, 0, -1))
    t0, t1 = {
        "last": ("n_tr + n_vl", "n"),
        "ninth": ("CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)", "CAST(floor(n * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS BIGINT)"),
        "rotated": ("CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)", "CAST(floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)"),
    }[test]
    turn = f"((pos - CAST(floor(n * {rotation} / 5.0::DOUBLE / 2.0::DOUBLE) AS BIGINT)) % n + n) % n" if rotation else "pos"
    within = f"rn <= {cap}" if cap else "TRUE"
    return f"""
WITH t AS ({source}),
o AS (SELECT corpus, regexp_extract_all(text, '(?s).') AS a, sum(length(text)) OVER (PARTITION BY corpus ORDER BY doc_id) - length(text) AS start FROM t),
c0 AS (SELECT corpus, CAST(start + generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS ch FROM o),
b AS (SELECT *, {t0} AS t0, {t1} AS t1 FROM (
    SELECT corpus, count(*) AS n, count(DISTINCT ch) AS v, CAST(floor(CAST(0.8 AS DOUBLE) * count(*)) AS BIGINT) AS n_tr, CAST(floor(CAST(0.1 AS DOUBLE) * count(*)) AS BIGINT) AS n_vl FROM c0 GROUP BY corpus)),
chars AS (SELECT corpus, {turn} AS pos, ch FROM c0 JOIN b USING (corpus)),
x AS (SELECT corpus, pos, ch, {lags} AS ctx FROM chars WINDOW w AS (PARTITION BY corpus ORDER BY pos)),
parts AS (
    SELECT corpus, pos < n_tr AS train, CASE WHEN pos < n_tr THEN pos ELSE pos - t0 END AS off, ch, ctx, {KINDS[kind]} AS kind
    FROM x JOIN b USING (corpus) WHERE pos < n_tr OR (pos >= t0 AND pos < t1)),
ks AS (SELECT unnest(range(1, {k + 1}))::INT AS k),
ng AS (SELECT corpus, k, right(ctx, k) AS ctx, ch, count(*) AS c FROM parts, ks WHERE train AND off >= k GROUP BY ALL),
tot AS (SELECT corpus, k, ctx, CAST(sum(c) AS BIGINT) AS total FROM ng GROUP BY ALL),
te AS (SELECT corpus, k, right(ctx, k) AS ctx, ch, kind, row_number() OVER (PARTITION BY corpus, k, ch ORDER BY off) AS rn FROM parts, ks WHERE NOT train AND off >= k),
run AS (SELECT corpus, k, ctx, ch, kind, count(*) AS n, count(*) FILTER ({within}) AS ns FROM te GROUP BY ALL),
occ AS (
    SELECT run.corpus, run.k, run.ctx, run.ch, kind, run.n, ns, coalesce(total, 0) AS total, coalesce(c, 0) AS c, v
    FROM run LEFT JOIN tot ON run.corpus = tot.corpus AND run.k = tot.k AND run.ctx = tot.ctx
    LEFT JOIN ng ON run.corpus = ng.corpus AND run.k = ng.k AND run.ctx = ng.ctx AND run.ch = ng.ch JOIN b ON run.corpus = b.corpus)"""


def surprisal(alpha: float = 1.0) -> str:
    """CTEs after ``base``: s (surprisal by character), cov, freq."""
    return f""",
su AS (SELECT *, -log2((c + {alpha}::DOUBLE) / (total + {alpha}::DOUBLE * v)) AS su FROM occ),
s AS (SELECT corpus, k, ch, max(kind) AS type, sum(ns * su) AS sum_surp, sum(ns * su * su) AS sum_sq, CAST(sum(ns) AS BIGINT) AS n_sum, CAST(sum(n) AS BIGINT) AS n,
             CAST(coalesce(sum(n) FILTER (total > 0), 0) AS BIGINT) AS ctx_hit FROM su WHERE kind IN ('structural', 'lexical') GROUP BY corpus, k, ch),
cov AS (SELECT corpus, k, CAST(coalesce(sum(n) FILTER (total > 0), 0) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total FROM occ GROUP BY corpus, k),
freq AS (SELECT corpus, ch, count(*) AS freq FROM parts WHERE train GROUP BY corpus, ch)"""


def gain(ddof: int = 1) -> str:
    """CTEs after ``surprisal``: ci, g (gain with coverage), kmax."""
    return f""",
ci AS (SELECT *, m - half AS lo, m + half AS hi FROM (SELECT *, sum_surp / n_sum AS m,
       1.96::DOUBLE * sqrt(greatest((sum_sq - n_sum * (sum_surp / n_sum) * (sum_surp / n_sum)) / CASE WHEN n_sum > {ddof} THEN n_sum - {ddof} END, 0)) / sqrt(n_sum) AS half FROM s WHERE n >= 30 AND n_sum > 0)),
g AS (SELECT a.corpus, a.ch, a.type, a.k, o.m AS s1, o.lo AS s1_lo, o.hi AS s1_hi, o.n AS n1, a.m AS sk, a.lo AS sk_lo, a.hi AS sk_hi, a.ctx_hit / a.n AS coverage, o.m - a.m AS cg
      FROM ci a JOIN ci o ON a.corpus = o.corpus AND a.ch = o.ch AND o.k = 1 WHERE a.k > 1),
kmax AS (SELECT corpus, coalesce(max(k) FILTER (k > 1 AND hits / total >= 0.5), 1) AS kmax FROM cov GROUP BY corpus)"""


def panel(tau: float = 0.5) -> str:
    """CTE after ``gain``: p, the regression panel."""
    return f""",
p AS (SELECT g.corpus, g.ch AS char_id, k, cg, log2(k) AS log2k, CASE WHEN type = 'structural' THEN 1 ELSE 0 END AS structural, log2(greatest(coalesce(freq, 1) / n_tr, 1e-10)) AS logfreq
      FROM g JOIN kmax USING (corpus) LEFT JOIN freq ON g.corpus = freq.corpus AND g.ch = freq.ch JOIN b ON g.corpus = b.corpus WHERE k <= kmax AND coverage >= {tau})"""


def fwl(rows: str = "p", by: str = "corpus") -> str:
    """CTE fit: beta3 and its clustered error of each group of ``rows``, by removing from y and the
    interaction what the other columns explain, one column after the other."""
    cols, out = ["one", "log2k", "structural", "logfreq"], [f", q0 AS (SELECT *, 1.0::DOUBLE AS one, log2k * structural AS x, cg AS y, structural * 1.0::DOUBLE AS st, logfreq AS lf, log2k AS lk FROM {rows})"]
    names = {"one": "one", "log2k": "lk", "structural": "st", "logfreq": "lf"}
    rest = ["lk", "st", "lf", "x", "y"]
    for i, col in enumerate(cols):
        c = names[col]
        cut = ", ".join(f"{r} - {c} * coalesce(sum({r} * {c}) OVER w / nullif(sum({c} * {c}) OVER w, 0), 0) AS {r}" for r in rest if r != c)
        rest = [r for r in rest if r != c]
        out.append(f"q{i + 1} AS (SELECT * REPLACE ({cut}) FROM q{i} WINDOW w AS (PARTITION BY {by}))")
    out.append(f"f AS (SELECT *, sum(x * y) OVER w / sum(x * x) OVER w AS b3, sum(x * x) OVER w AS xx FROM q4 WINDOW w AS (PARTITION BY {by}))")
    out.append(f"fg AS (SELECT {by}, char_id, any_value(b3) AS b3, any_value(xx) AS xx, sum(x * (y - b3 * x)) AS s, count(*) AS m, max(structural) AS st FROM f GROUP BY {by}, char_id)")
    out.append(f"fit AS (SELECT {by}, any_value(b3) AS b3, CAST(sum(m) AS BIGINT) AS n_obs, count(*) AS n_clusters, CAST(sum(st) AS BIGINT) AS n_structural_clusters, "
               "sqrt(sum(s * s) / (any_value(xx) * any_value(xx)) * count(*) / (count(*) - 1) * (sum(m) - 1) / (sum(m) - 5)) AS se FROM fg GROUP BY " + by + ")")  # fmt: skip
    return ",\n".join(out)
