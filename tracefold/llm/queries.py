"""The queries of this subpackage: op<N>_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tracefold.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, module: str, function: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"tracefold.llm.{module}"), function)(table(spark, sf_dir, name))

    return run


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.quality import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.resampling import resampling_digest

    return resampling_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.lexical import search_digest

    return search_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": _over("documents", "secrets", "secret_digest"),
    "op2_top_k": _over("embeddings", "topk", "top_k_digest"),
    "op3_pii": _over("documents", "pii", "pii_digest"),
    "op4_packing": _over("documents", "packing", "pack_documents"),
    "op5_near_dup": _over("documents", "neardup", "near_dup_digest"),
    "op6_benchmark_leaks": _leaks,
    "op7_token_files": _over("documents", "tokenfiles", "token_file_digest"),
    "op8_language_id": _over("documents", "langid", "language_digest"),
    "op9_token_counts": _over("documents", "tokencount", "token_count_digest"),
    "op10_line_dedup": _over("documents", "linededup", "line_dedup_digest"),
    "op11_quality": _quality,
    "op12_resampling": _resampling,
    "op13_ranked_search": _ranked_search,
}

LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.doc_id, k.pos, k.line, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone
  FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



TOP_K_SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (x.embedding[i] > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM embeddings q, embeddings x WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""

LEAKS_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM t),
g AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
k AS (SELECT id, ' ' || array_to_string(w, ' ') || ' ' AS run FROM w WHERE side = 'b' AND len(w) IN (3, 4)),
n AS (SELECT id, count(*) AS n FROM g WHERE side = 'b' AND id NOT IN (SELECT id FROM k) GROUP BY id),
c AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g d JOIN g b ON d.g = b.g AND d.side = 'd' AND b.side = 'b' GROUP BY ALL)
SELECT w.id AS doc_id, k.id AS item_id, 1::BIGINT AS shared, 1::BIGINT AS item_shingles FROM k JOIN w ON side = 'd' AND contains(' ' || array_to_string(w, ' ') || ' ', run)
UNION ALL SELECT doc_id, item_id, shared::BIGINT AS shared, n::BIGINT AS item_shingles FROM c JOIN n ON c.item_id = n.id WHERE 100 * shared >= 75 * n
"""


NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 75 * (x.n + y.n - hits)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def _secret_sql() -> str:
    """All rules scanned over every text, with the places of the matches summed from the texts between them."""
    from tracefold.llm.secrets import BASE_RULES, RULES

    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps, "
                     f"list_transform(regexp_extract_all(t, '{pattern}'), lambda h: length(regexp_extract(h, '{pattern}', {r.value_group}))) AS widths FROM d WHERE regexp_matches(t, '{pattern}')")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT doc_id, ord, kind, length(hits[i]) AS n,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s0
      FROM i WHERE widths[i] >= least),
p AS (SELECT doc_id, ord, kind, s0, concat_ws(':', kind, s0::BIGINT::VARCHAR, (s0 + n)::BIGINT::VARCHAR) AS p FROM s),
g AS (SELECT doc_id, {counts}, string_agg(p, ',' ORDER BY s0, ord) FILTER (WHERE ord < {len(BASE_RULES)}) AS base, string_agg(p, ',' ORDER BY s0, ord) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


#: The crc32 of every distinct word is worked out byte by byte, by the usual table of 256 values.
RESAMPLING_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
c AS (SELECT side, id, w, count(*) AS n FROM w GROUP BY ALL),
hx AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM c)),
v AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM hx, tab),
f AS (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM c JOIN v USING (w) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
e AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN d ON doc_id = id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT e.*, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM e LEFT JOIN r USING (doc_id)
"""

RANKED_SEARCH_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
tf AS (SELECT doc_id, w, count(*)::BIGINT AS tf FROM w GROUP BY ALL),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM w GROUP BY doc_id),
k AS (SELECT count(*)::BIGINT AS N_, sum(n)::BIGINT AS L FROM n),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * N_) // L) AS m FROM n, k),
t AS (SELECT w, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT w, count(*)::BIGINT AS df FROM tf GROUP BY w), k),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM b JOIN t USING (w) JOIN tf USING (w) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

SQL: dict[str, str] = {"op5_near_dup": NEAR_DUP_SQL, "op12_resampling": RESAMPLING_SQL, "op13_ranked_search": RANKED_SEARCH_SQL, "op2_top_k": TOP_K_SQL, "op1_secret_scan": _secret_sql(), "op6_benchmark_leaks": LEAKS_SQL, "op10_line_dedup": LINE_DEDUP_SQL}
