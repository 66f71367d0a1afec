"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe_round_trip
from .decontaminate import op3_contaminated
from .divergence import op12_source_divergence
from .exactdup import op6_repeated_bytes
from .htmltext import op1_main_text
from .langid import op2_language
from .lm import op8_lm_score
from .packing import op11_packed_sequences
from .paragraphs import op7_repeated_passages
from .periodic import op13_periodic_runs
from .simhash import op10_simhash_near_duplicates
from .toxicity import op9_toxicity
from .vectors import op5_vector_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_main_text, op2_language, op3_contaminated, op4_bpe_round_trip, op5_vector_duplicates, op6_repeated_bytes,
        op7_repeated_passages, op8_lm_score, op9_toxicity, op10_simhash_near_duplicates, op11_packed_sequences,
        op12_source_divergence, op13_periodic_runs)
}
# Brute force in DuckDB. The others need learned weights, XXH64, crc32 or byte-pair merges.
SQL: dict[str, str] = {
    "op3_contaminated": r"""
WITH item AS MATERIALIZED (SELECT *, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)),
part AS MATERIALIZED (SELECT item_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM item, unnest(range(n - 4)) AS t(i)),
part_count AS (SELECT item_id, n, s, count(*) AS c FROM part GROUP BY ALL),
doc AS (SELECT doc_id, w, len(w) AS m FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
cut AS MATERIALIZED (SELECT doc_id, m, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM doc, unnest(range(m - 4)) AS t(p)),
laid AS MATERIALIZED (  -- every start in documents that share a shingle with an item of the size
  SELECT doc_id, n, unnest(range(greatest(m - n, 0) + 1)) AS start, least(n, m) AS size
  FROM (SELECT DISTINCT doc_id, m, n FROM cut JOIN (SELECT DISTINCT n, s FROM part) USING (s))),
held AS (
  SELECT doc_id, n, start, size, s, count(*) AS c FROM laid JOIN cut USING (doc_id)
  WHERE p BETWEEN start AND start + size - 5 GROUP BY ALL),
compared AS (
  SELECT doc_id, item_id, n, start, CAST(sum(least(h.c, q.c)) AS BIGINT) AS shared, min(size) + min(n) - 8 AS total
  FROM held h JOIN part_count q USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, start AS start_word, n AS n_words, shared / CAST(total - shared AS DOUBLE) AS similarity FROM compared
WHERE shared / CAST(total - shared AS DOUBLE) >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    "op5_vector_duplicates": """
WITH RECURSIVE able AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
named AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named""",
    "op6_repeated_bytes": """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(n - 49)) AS t(p)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
edge AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, -1) AS fresh FROM hit),
run AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edge),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM span),
gone AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT DISTINCT lang, source FROM d),
cell AS MATERIALIZED (  -- every group and every kept term of its language
  SELECT lang, source, term, coalesce(n, 0) AS n, count(*) OVER (PARTITION BY lang, source) AS v,
         sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS lang_n
  FROM every JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
p AS MATERIALIZED (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM cell),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM part QUALIFY part = 'pair' OR rank <= 200""",
}
