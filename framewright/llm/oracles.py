"""SQL (DuckDB) that says what a query returns, for those queries that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, COPIED_OWNERS, HEX, LEAST_ASSIGNED, MOST_REPOSITORIES, OWNED

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, CAST(len(words) - 2 AS BIGINT)), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS items FROM w),
c AS (SELECT doc_id, items, len(items) AS n, CASE WHEN len(items) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY items) END AS class_id FROM s),
e AS (SELECT doc_id AS id, n, unnest(items) AS item FROM c WHERE doc_id = class_id),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.item = b.item AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT class_id AS id, class_id AS near FROM c UNION SELECT r.id, p.b FROM r JOIN p ON r.near = p.a),
g AS (SELECT id, min(near) AS component_id FROM r GROUP BY id)
SELECT c.doc_id, c.n AS n_shingles, g.component_id, c.doc_id = g.component_id AS kept, c.class_id FROM c JOIN g ON g.id = c.class_id"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
h AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda k: CAST(bits[5 * i + k + 1] AS INTEGER) * (16 >> k))) AS INTEGER) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url FROM h"""

CHATS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(pattern: str, kind: int, name: str, group: int, keep: str) -> str:
    """Rows (rid, start, kind, end, value) of a pattern: the lengths of matches and of what lies between them add up to places."""
    q = _quoted(pattern)
    return f"""m{name} AS (SELECT rid, unnest(regexp_extract_all(text, {q})) AS m, unnest(regexp_extract_all(text, {q}, {group})) AS v, unnest(string_split_regex(text, {q})[:-2]) AS piece, unnest(range(CAST(len(regexp_extract_all(text, {q})) AS BIGINT))) AS k FROM d WHERE regexp_matches(text, {q})),
p{name} AS (SELECT rid, v, sum(length(piece) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS stop, length(m) AS size FROM m{name}),
s{name} AS (SELECT rid, CAST(stop - size AS BIGINT) AS a, {kind} AS kind, CAST(stop AS BIGINT) AS b, v FROM p{name} WHERE {keep})"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source AS owner, coalesce(source, '-') || '/' || coalesce(lang, '-') AS repository FROM documents),
{_matches(ASSIGN, 0, "0", 2, f"length(v) >= {LEAST_ASSIGNED}")},
{_matches(ACCESS, 1, "1", 0, "true")},
{_matches(HEX, 2, "2", 0, "true")},
{_matches(OWNED, 3, "3", 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")},
base AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
every AS (SELECT * FROM base UNION ALL SELECT * FROM s3 WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = s3.rid AND base.a < s3.b AND s3.a < base.b)),
o AS (SELECT v, count(DISTINCT coalesce(owner, '-')) AS owners, count(DISTINCT repository) AS repositories FROM every JOIN d USING (rid) GROUP BY v),
l AS (SELECT every.*, owners = 1 AND repositories <= {MOST_REPOSITORIES} AS live, NOT (owners = 1 AND repositories <= {MOST_REPOSITORIES}) AND owners >= {COPIED_OWNERS} AS copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS said FROM every JOIN o USING (v)),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(said, ',' ORDER BY a, kind, b) FILTER (WHERE kind < 3) AS base,
 string_agg(said, ',' ORDER BY a, kind, b) FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE copied AND kind < 3) AS n_copied FROM l GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (rid)"""

ORACLES: dict[str, str] = {"op1_minhash_dedup": NEAR_DUPLICATES, "op2_warc_index": ARCHIVES, "op4_chat_assembly": CHATS, "op7_secret_ownership": SECRETS}
