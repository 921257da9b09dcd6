"""DuckDB SQL for the queries that SQL can express (brute force over all rows)."""

from __future__ import annotations

# [\x20\x09-\x0D] for trim(), built from code points.
_WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, pos, line, r.key IS NOT NULL AND k.doc_id <> last_doc AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda p: array_to_string(w[p:p + 12], ' '))) AS win
  FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, ns WHERE len(w) >= n),
dk AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dw),
h AS (SELECT dk.doc_id, dk.p, dk.n, iw.item_id FROM dk JOIN iw ON dk.win = iw.win AND dk.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
         -ln((('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (0.5 + 1.5 * coalesce(q, 0.4)) AS key
  FROM documents LEFT JOIN (SELECT doc_id, avg(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n, 3 * CAST(sum(size) AS DOUBLE) AS most,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
-- share, cap what is above its limit, share the rest again, until none is above
fill AS (
  SELECT source, n, most, w, false AS capped, CAST(0 AS DOUBLE) AS level, 0 AS step FROM s
  UNION ALL
  SELECT source, n, most, w, capped OR lv * w > most, lv, step + 1
  FROM (SELECT *, (sum(n) OVER () - coalesce(sum(most) FILTER (capped) OVER (), 0)) / nullif(sum(w) FILTER (NOT capped) OVER (), 0) AS lv FROM fill)
  WHERE step < 60),
t AS (SELECT source, n, CASE WHEN capped THEN most ELSE least(most, level * w) END AS target FROM fill WHERE step = 60),
p AS (
  SELECT doc_id, size, d.source, t.n, target, CASE WHEN t.n > 0 THEN least(3, floor(target / t.n)) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN upto - size / 2 <= target - epochs * n THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""

TRIE = """
WITH t AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
         ORDER BY turn NULLS FIRST, concat(md5(coalesce(role, '')), md5(coalesce(text, '')))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
-- unsigned CRC-32 of the decimal conv_id: each byte, and eight shifts
h AS (
  SELECT c, ts, xor(4294967295::BIGINT, list_reduce(
    flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x >> 1, 3988292384::BIGINT * (x & 1)) END, 4294967295::BIGINT)) % 9 AS h FROM t),
s AS (SELECT h.c, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS s FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5),
p AS (SELECT c, d, s[1:d] AS k, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].t) END AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, k),
m AS (SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]),
ch AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY parent, d - 1),
f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN ch ON ch.parent = m.conv_id AND ch.d = m.d),
tot AS (
  SELECT a, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY a, k[1:a])
SELECT conv_id, f.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(tot.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN tot ON tot.a = f.d AND tot.k = f.k
"""

SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, n, term),
x AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM f, s GROUP BY term),
c AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM i JOIN x USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM c WHERE score > 0)
WHERE rank <= 50
"""

# windows of 50 bytes as 100 hexadecimal digits, by their md5
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
-- pieces of 1000 windows: a place in a long string is found by walking there
c AS (SELECT r, doc_id, a, substr(x, 2000 * a + 1, 2098) AS x, least(1000, n - 1000 * a) AS m FROM (
  SELECT r, doc_id, x, length(x) // 2 - 49 AS n, unnest(range(0, (length(x) // 2 - 49 + 999) // 1000)) AS a FROM d WHERE length(x) >= 100)),
l AS (SELECT r, doc_id, a, range(0, m) AS bs, list_transform(range(0, m), lambda p: md5(substr(x, 2 * p + 1, 100))) AS ss FROM c),
w AS (SELECT r, doc_id, 1000 * a + b AS p, s FROM (SELECT r, doc_id, a, unnest(bs) AS b, unnest(ss) AS s FROM l)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w JOIN f USING (s) WHERE coalesce(doc_id, 9223372036854775807) > low),
runs AS (SELECT r, min(p) AS s, max(p) + 50 AS e FROM (
  SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY r, k),
pieces AS (
  SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b FROM runs),
cut AS (
  SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last_end,
         string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept
  FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(concat(coalesce(kept, ''), substr(x, 2 * coalesce(last_end, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op8_decontamination": DECONTAMINATION,
    "op9_mixing": MIXING,
    "op11_prefix_trie": TRIE,
    "op12_search": SEARCH,
    "op13_suffix_dedup": REPEATS,
}
