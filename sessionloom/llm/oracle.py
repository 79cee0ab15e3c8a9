"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations

from ..plans.general import LIVE_ENTRIES_SQL, WS_SQL

_TOKENS = f"len(regexp_extract_all(message_content, '[^{WS_SQL[1:]}+'))"
_LIMITS = """lim AS (SELECT s.session_key, p.max_tokens FROM (SELECT * FROM sessions
  QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ingested_at DESC) = 1) s JOIN chunk_policies p USING (policy_id))"""

_WALK = f"""WITH RECURSIVE {LIVE_ENTRIES_SQL},
ls AS (SELECT session_key FROM (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ingested_at DESC) = 1) WHERE deleted_at IS NULL),
edge AS (SELECT a.session_key, a.entry_key, a.link_id, min(b.entry_key) AS parent FROM live a LEFT JOIN live b
  ON a.session_key = b.session_key AND a.link_id = b.node_id GROUP BY ALL),
tip AS (SELECT session_key, arg_max(entry_key, (record_type = 'leaf')::INT * 1000000000 + line_no) AS entry_key FROM live GROUP BY 1),
walk AS (SELECT e.session_key, e.entry_key, e.link_id, e.parent, 0 AS pos, [e.entry_key] AS seen, false AS ring FROM edge e JOIN tip t ON t.entry_key = e.entry_key
  UNION ALL SELECT e.session_key, e.entry_key, e.link_id, e.parent, w.pos + 1, list_append(w.seen, e.entry_key), list_contains(w.seen, e.entry_key)
  FROM walk w JOIN edge e ON e.entry_key = w.parent WHERE NOT w.ring),
turns AS (SELECT w.session_key, w.pos, l.message_role AS role FROM walk w JOIN live l USING (entry_key)
  WHERE l.record_type = 'message' AND l.message_role IN ('user', 'assistant') AND NOT w.ring
  AND coalesce(regexp_matches(l.message_content, '[^{WS_SQL[1:]}'), false)),
nexts AS (SELECT session_key, role, lead(role) OVER (PARTITION BY session_key ORDER BY pos DESC) AS nxt FROM turns),
judged AS (SELECT ls.session_key, CASE
  WHEN EXISTS (SELECT 1 FROM walk w WHERE w.session_key = ls.session_key AND (w.ring OR (w.parent IS NULL AND w.link_id IS NOT NULL))) THEN 'broken'
  WHEN NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_key = ls.session_key) THEN 'empty'
  WHEN EXISTS (SELECT 1 FROM nexts n WHERE n.session_key = ls.session_key AND role = 'user' AND nxt IS DISTINCT FROM 'assistant') THEN 'missing_reply'
  ELSE 'ok' END AS verdict FROM ls)
"""

_PAIRS = f"""WITH {LIVE_ENTRIES_SQL},
w AS (SELECT entry_key, list_transform(regexp_extract_all(message_content, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS ws FROM live
  WHERE record_type = 'message' AND message_role IN ('user', 'assistant')),
t AS (SELECT DISTINCT entry_key, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE len(ws) >= 24),
n AS (SELECT entry_key, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.entry_key AS a, b.entry_key AS b, count(*) AS common FROM t a JOIN t b ON a.s = b.s AND a.entry_key < b.entry_key GROUP BY 1, 2)
SELECT a AS entry_key_a, b AS entry_key_b FROM c JOIN n x ON x.entry_key = a JOIN n y ON y.entry_key = b WHERE 5 * common >= 3 * (x.n + y.n - common)"""

_GROUPS = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\nSELECT a AS", 1)[0] + """,
sig AS (SELECT entry_key, md5(string_agg(s, '|' ORDER BY s)) AS h FROM t GROUP BY 1),
cls AS (SELECT entry_key, min(entry_key) OVER (PARTITION BY h) AS class_id FROM sig),
near AS (SELECT DISTINCT ca.class_id AS a, cb.class_id AS b FROM c JOIN n x ON x.entry_key = c.a JOIN n y ON y.entry_key = c.b JOIN cls ca ON ca.entry_key = c.a JOIN cls cb ON cb.entry_key = c.b
  WHERE 5 * common >= 3 * (x.n + y.n - common) AND ca.class_id <> cb.class_id),
edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT k.entry_key, k.class_id, least(k.class_id, (SELECT min(b) FROM reach r WHERE r.a = k.class_id)) AS group_id, (SELECT count(*) FROM edge e WHERE e.a = k.class_id) AS links FROM cls k"""

ORACLE = {
    "p2_groups": _GROUPS,
    "p1_covered": f"WITH {LIVE_ENTRIES_SQL}, {_LIMITS} SELECT entry_key, true AS fits, true AS covers FROM live JOIN lim USING (session_key) WHERE {_TOKENS} > max_tokens",
    "p8_coverage": "SELECT budget_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS gaps, 0::BIGINT AS overfull FROM token_budgets",
    "p2_found": _PAIRS,
    "p1_found": f"WITH {LIVE_ENTRIES_SQL}, {_LIMITS} SELECT entry_key FROM live JOIN lim USING (session_key) WHERE {_TOKENS} > max_tokens",
    "p4_found": _WALK + "SELECT session_key FROM judged WHERE verdict <> 'ok'",
    "p4_verdicts": _WALK + "SELECT session_key, verdict FROM judged",
    "p4_conversations": _WALK + """SELECT w.session_key, (max(w.pos) OVER (PARTITION BY w.session_key)) - w.pos AS turn, w.entry_key,
  coalesce(l.message_role, l.record_type) AS speaker, coalesce(l.message_content, l.summary) AS content
  FROM walk w JOIN judged j ON j.session_key = w.session_key AND j.verdict = 'ok' JOIN live l ON l.entry_key = w.entry_key""",
}
