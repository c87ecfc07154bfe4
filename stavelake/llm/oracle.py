"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from stavelake.llm import license_scan

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS safe_role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe_text,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe_text) + CASE WHEN opens THEN length(safe_role) + 8 + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

LINES = r"""
WITH docs AS (SELECT doc_id, text, source, md5(text) AS body FROM documents),
lines AS (
  SELECT doc_id, body, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs
), bare AS (SELECT *, trim(raw, E' \t\n\x0B\f\r') AS line FROM lines),
wide AS (
  SELECT line, min((doc_id, place)) AS first FROM bare WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 10
), marked AS (
  SELECT b.*, w.line IS NOT NULL AND (b.doc_id, b.place) <> w.first AS gone FROM bare b LEFT JOIN wide w ON b.line = w.line AND b.line <> ''
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
  count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed
FROM marked GROUP BY doc_id, body
"""


def _licenses() -> str:
    quoted = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), 2 * chr(39))}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    grams = "SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"
    return f"""
WITH templates(template, license, text) AS (VALUES {quoted}),
tg AS ({grams.format(key="template", words=words, table="templates")}),
dg AS ({grams.format(key="doc_id", words=words, table="documents")}),
n AS (SELECT template, count(*) AS of FROM tg GROUP BY template)
SELECT doc_id, license, template::INTEGER AS template, count(*) / any_value(of) AS containment
FROM dg JOIN tg USING (gram) JOIN n USING (template) JOIN templates USING (template)
GROUP BY doc_id, license, template HAVING count(*) / any_value(of) >= 0.8
"""


REPEATS = r"""
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
blocks AS (SELECT doc_id, low, substr(h, 1 + 2 * low, 598) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 200)) AS low FROM docs)),
places AS (SELECT doc_id, low, part, unnest(range(0, least(200, length(part) // 2 - 99))) AS q FROM blocks),
keyed AS (SELECT doc_id, low + q AS p, md5_number(substr(part, 1 + 2 * q, 200)) AS k FROM places),
firsts AS (SELECT k, min((doc_id, p)) AS first FROM keyed GROUP BY k HAVING count(*) > 1),
grams AS (SELECT doc_id, p, true AS again FROM keyed JOIN firsts USING (k) WHERE (doc_id, p) <> first),
hits AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM grams WHERE again),
runs AS (SELECT doc_id, p, sum((gap IS NULL OR gap > 100)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, run, min(p) AS low, max(p) + 100 AS high FROM runs GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, run, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before,
    run = max(run) OVER (PARTITION BY doc_id) AS is_last FROM spans
),
kept AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(high - low) AS n_removed,
    string_agg(substr(h, 1 + 2 * before, 2 * (low - before)), '' ORDER BY run) || any_value(substr(h, 1 + 2 * high)) FILTER (is_last) AS h
  FROM cuts c JOIN docs d ON c.doc_id = d.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

URLS = r"""
WITH RECURSIVE rules(action, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), parts AS (
  SELECT row_number() OVER () AS rid, page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT p.rid, p.page_id, p.host, p.path,
    arg_max(r.host || r.path, length(r.host || r.path) * 2 + (r.action = 'block')::INT) AS rule,
    arg_max(r.action, length(r.host || r.path) * 2 + (r.action = 'block')::INT) AS action
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rid, p.page_id, p.host, p.path
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM parts
), edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst),
steps AS (
  SELECT 'trust' AS kind, src AS f, dst AS t, n / sum(n) OVER (PARTITION BY src) AS part FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), walk(i, kind, host, mass) AS (
  SELECT 0, k.kind, host, avg(CASE WHEN ruled.action = k.action THEN 1.0 ELSE 0.0 END)
  FROM ruled, (VALUES ('trust', 'allow'), ('distrust', 'block')) k(kind, action) GROUP BY k.kind, host
  UNION ALL
  SELECT w.i + 1, s.kind, s.t, sum(w.mass * s.part * 0.85) FROM walk w JOIN steps s ON w.kind = s.kind AND w.host = s.f WHERE w.i < 500 GROUP BY w.i, s.kind, s.t
), scores AS (
  SELECT host, sum(CASE WHEN kind = 'distrust' THEN mass ELSE -mass END) AS excess FROM walk GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN excess > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""

WARC = r"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM rows),
hashed AS (SELECT *, page_id IS DISTINCT FROM first AND first IS NOT NULL AS again, sha1(payload) AS hex FROM marked)
SELECT page_id, strlen(payload) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM hashed
"""

STATEMENTS = {"op1_suffix_dedup": REPEATS, "op4_url_filter": URLS, "op6_warc": WARC, "op3_chat_format": CHAT, "op7_line_dedup": LINES, "op10_license_scan": _licenses()}
