"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH body AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS b
  FROM documents),
grouped AS (SELECT b, min(doc_id) AS keep_id, count(*) AS group_size FROM body GROUP BY b)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(b) AS text_sha256
FROM body JOIN grouped USING (b)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')".format(_LOWER)

LEAKS = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hits AS (
  SELECT d.doc_id, p, d.n, win.item_id
  FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS k
        FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS r(p)) d
  JOIN win ON win.n = d.n AND win.k = d.k),
covered AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_hit
  FROM hits, unnest(range(0, n)) AS r(o) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# CRC-32 by its definition: the table of all bytes from the polynomial, then a fold over the bytes.
RESAMPLE = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
of_docs AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM doc) GROUP BY w),
of_items AS (
  SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
word AS (
  SELECT w, hex(w) AS h FROM (SELECT w FROM of_docs UNION SELECT w FROM of_items)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2),
      lambda i: 16 * (instr('0123456789ABCDEF', h[i + 1]) - 1) + instr('0123456789ABCDEF', h[i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM word, steps),
held AS (
  SELECT bucket, sum(coalesce(d.n, 0)) AS s, sum(coalesce(i.n, 0)) AS t
  FROM hashed LEFT JOIN of_docs d USING (w) LEFT JOIN of_items i USING (w) GROUP BY bucket),
total AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM held),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS g
  FROM held, total),
weighed AS (
  SELECT doc_id, count(*) AS n, sum(g) AS weight
  FROM (SELECT doc_id, unnest(w) AS w FROM doc) JOIN hashed USING (w) JOIN gain USING (bucket)
  GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score,
  CASE WHEN rank <= (SELECT count(*) FROM drawn) * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op7_exact_dedup": EXACT_DEDUP,
        "op8_benchmark_decontamination": LEAKS,
        "op13_importance_resampling": RESAMPLE,
    }
