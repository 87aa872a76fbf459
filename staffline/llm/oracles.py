"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"

NEAR_COPIES = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0) GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) JOIN n na ON na.doc_id = a.doc_id
  JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS near FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""

TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

#: Share: upper percentile, least distance from the median.
_SHARES = {
    "floor(10000.0 * n_symbols / greatest(word_chars, 1))": (75, 20),
    "floor(10000.0 * n_dup_lines / greatest(n_lines, 1))": (75, 150),
    "floor(10000.0 * n_repeat_words / greatest(n_words, 1))": (90, 120),
}
_LONG = " UNION ALL ".join(
    f"SELECT lang, source, {i} AS k, {upper} AS upper, {least} AS least, CAST({share} AS BIGINT) AS v FROM base WHERE NOT base_failed"
    for i, (share, (upper, least)) in enumerate(_SHARES.items()))
_WITHIN = " AND ".join(
    f"{share} <= (SELECT max(most) FROM limits l WHERE l.k = {i} AND l.lang IS NOT DISTINCT FROM base.lang "
    "AND l.source IS NOT DISTINCT FROM base.source)"
    for i, share in enumerate(_SHARES))

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
windows AS (SELECT doc_id, i, ws[i:i + 2] AS three FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) t(k) GROUP BY 1),
base AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{SYMBOL}')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
cells AS (SELECT lang, source, k, upper, least, v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)) AS cell, count(*) AS n FROM ({_LONG}) GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY cell) AS c, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM cells),
ranks AS (SELECT lang, source, k, least, min(cell) FILTER (WHERE 100 * c >= 50 * total) AS middle, min(cell) FILTER (WHERE 100 * c >= upper * total) AS high
  FROM sums GROUP BY ALL),
limits AS (SELECT lang, source, k, middle + 20 * greatest(high - middle, least) AS most FROM ranks)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  coalesce(NOT base_failed AND {_WITHIN}, FALSE) AS kept FROM base"""

_BIT = "CAST(power(2, ascii(f) - ascii('A')) AS INTEGER)"
_HIT, _GONE = "mask & bit <> 0", "mask & before <> 0"

FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, {_BIT} AS bit,
    coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda f: CASE WHEN f = '' THEN 0 ELSE {_BIT} END)), 0)::INTEGER AS before
  FROM (SELECT filter_order, step, filter_order[step] AS f FROM o, range(1, 6) r(step))),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    sum(n) FILTER (WHERE NOT ({_HIT}) AND NOT ({_GONE})) AS kept, sum(n) FILTER (WHERE {_HIT} AND NOT ({_GONE})) AS removed,
    sum(n) FILTER (WHERE {_HIT} AND {_GONE}) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE {_HIT} AND NOT ({_GONE})) AS good_lost, sum(toxic) FILTER (WHERE {_HIT} AND NOT ({_GONE})) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

ORACLES = {"op2_near_copies": NEAR_COPIES, "op5_top_k": TOP_K, "op6_quality_rules": QUALITY_RULES, "op13_filter_audit": FILTER_AUDIT}
