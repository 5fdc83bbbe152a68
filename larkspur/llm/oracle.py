"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM
    (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM
    (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# The rules of quality.py, written again for RE2 so that the query is held against something of its own.
PHRASES = (
    "all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use of cookies|javascript|lorem ipsum|licensed under the|released under the"
    r"|copyright \(c\)|click here|sign up now|subscribe to our|powered by|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|verwendet cookies|hier klicken"
    "|newsletter abonnieren|tous droits réservés|conditions d.utilisation|politique de confidentialité|utilise des cookies|cliquez ici|abonnez-vous"
    "|todos los derechos reservados|condiciones de uso|política de privacidad|utiliza cookies|haz clic aquí|suscríbete"
)
OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
x AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 2], ' ')) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, l, length(l) AS n, string_split_regex(lower(l), '[.!?…]+') AS s FROM (SELECT doc_id, unnest(lines) AS l FROM d)),
p AS (SELECT doc_id, sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS good FROM l
  WHERE 2 * length(rtrim(regexp_replace(l, '(?s)^.*[.!?:;…][\x22\x27)\]”»]*(?:[ \t\r]+|$)', ''), ' ' || chr(9) || chr(13))) <= n
    AND 2 * length(array_to_string(list_filter(s, lambda x: regexp_matches(x, '{PHRASES}')), '')) <= length(array_to_string(s, ''))
    AND length(regexp_replace(l, '[^|•]', '', 'g')) < 2 + n // 40 AND length(regexp_replace(l, '[^!#*$%&]', '', 'g')) < 5 + 5 * (n // 40) GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good FROM d LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * good >= 50 * word_chars AS kept
FROM s
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM x),
r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM r),
n AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, k, substr(x, 2000 * k + 1, 2098) AS y, least(1000, len(x) // 2 - 1000 * k) AS n FROM (SELECT doc_id, x, unnest(generate_series(0, (len(x) // 2 - 1) // 1000)) AS k FROM d WHERE len(x) > 0)),
b AS MATERIALIZED (SELECT doc_id, 1000 * k + j AS i, substr(y, 2 * j + 1, 2) AS c, CASE WHEN j <= len(y) // 2 - 50 THEN md5_number(substr(y, 2 * j + 1, 100)) END AS h
  FROM (SELECT doc_id, k, y, unnest(generate_series(0, n - 1)) AS j FROM p)),
m AS (SELECT h, min(doc_id) AS least FROM b WHERE h IS NOT NULL GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT b.doc_id, b.i FROM b JOIN m USING (h) WHERE b.doc_id > least),
f AS (SELECT b.doc_id, b.i, c,
    coalesce(max(CASE WHEN r.i IS NOT NULL THEN b.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.i = b.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM f),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
    coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS n, sha1(encode(t)) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 20), lambda k: ('0x' || substr(h, (2 * k + 1)::INT, 2))::INT) || [0] AS x FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((((x[1 + (5 * i) // 8] * 256 + x[2 + (5 * i) // 8]) >> (11 - (5 * i) % 8)::INT)) % 32))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""

OP13_VECTORS = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 40))"""

# A round: the nearest centroid of each vector, then the floor of the mean of each centroid's vectors.
OP13_ROUND = """,
a{k} AS MATERIALIZED (SELECT r, arg_min({{'c': c, 'd': d}}, {{'d': d, 'c': c}}) AS x FROM
  (SELECT r, c, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM v, c{k}) GROUP BY r)"""
OP13_MOVE = """,
c{next} AS MATERIALIZED (SELECT c, coalesce(s.m, c{k}.m) AS m FROM c{k} LEFT JOIN
  (SELECT c, list(q ORDER BY i) AS m FROM (SELECT x.c AS c, i, floor(sum(v[i]::DECIMAL(18, 0)) / count(*)) AS q
    FROM v JOIN a{k} USING (r), (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2) GROUP BY c) s USING (c))"""
OP13 = (
    OP13_VECTORS
    + "".join(OP13_ROUND.format(k=k) + (OP13_MOVE.format(k=k, next=k + 1) if k < 5 else "") for k in range(6))
    + """
SELECT vec_id, x.c::INT AS cluster, x.d::BIGINT AS distance, (sum(x.d) OVER (PARTITION BY x.c))::BIGINT AS cluster_inertia, (sum(x.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a5 USING (r) JOIN c5 ON c5.c = x.c
"""
)

SQL = {"op13_centroid_clustering": OP13, "op6_warc_archive": OP6, "op8_suffix_array_dedup": OP8, "op2_substring_dedup": OP2, "op3_chat_formatting": OP3, "op7_benchmark_decontamination": OP7, "op10_quality_rules": OP10}
