"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, exact_dedup, filter_audit, mixing, near_dup, repair, secrets
from .common import WORD

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '{WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {near_dup.WIDTH - 1}], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {near_dup.WIDTH - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL) q
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE {near_dup.DEN} * c >= {near_dup.NUM} * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def _control_count(column: str) -> str:
    """How many controls, with any backslashes after their first character, a text holds."""
    special = "\\^$.|?*+()[]{}"
    quote = lambda t: "".join("\\" + ch if ch in special else ch for ch in t)
    pattern = "|".join(f"{quote(c[0])}\\\\*{quote(c[1:])}" for c in chat.CONTROLS)
    return f"len(regexp_extract_all({column}, {_quoted(pattern)}))"


_PROBE = _quoted("</s>[INST] ok [/INST]")
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_PROBE} UNION ALL SELECT -7, 1, 'assistant', {_PROBE})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {_control_count("role")} + {_control_count("text")} + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE) + 1}) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM t GROUP BY conv_id
"""


def _matches() -> str:
    """One SELECT for each kind: its gaps, matches and what its group 2 held."""
    kinds = [("assign", secrets.ASSIGN, "len(g) >= 6"), ("access", secrets.ACCESS, "true"), ("hex", secrets.HEX, "true")]
    kinds += [(k, p, " AND ".join(f"regexp_matches(m, {_quoted(h)})" for h in holds) or "true") for k, _, p, _, holds in secrets.WEAK]
    parts = []
    for order, (kind, pattern, test) in enumerate(kinds):
        group = f"regexp_extract_all(text, {_quoted(pattern)}, 2)" if kind == "assign" else f"regexp_extract_all(text, {_quoted(pattern)})"
        parts.append(f"""
  SELECT doc_id, {order} AS ord, '{kind}' AS kind, '{secrets.ROLE[kind]}' AS role, start, start + length(m) AS stop FROM (
    SELECT doc_id, m[i] AS m, g[i] AS g, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, {_quoted(pattern)}) AS gaps, regexp_extract_all(text, {_quoted(pattern)}) AS m, {group} AS g FROM d)))
  WHERE {test}""")
    return " UNION ALL".join(parts)


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS MATERIALIZED ({_matches()}),
k AS (
  SELECT * FROM p WHERE ord < {len(secrets.BASE)}
  UNION ALL SELECT * FROM p w WHERE ord >= {len(secrets.BASE)} AND EXISTS (
    SELECT 1 FROM p o WHERE o.doc_id = w.doc_id AND o.role <> w.role AND o.start <= w.stop + {secrets.REACH} AND o.stop >= w.start - {secrets.REACH} AND (o.start >= w.stop OR o.stop <= w.start))),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS b, count(*) FILTER (WHERE ord = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(secrets.BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

ORACLES = {
    "op2_chat_format": CHAT, "op3_minhash_near_dedup": NEAR_DUPLICATES, "op8_mix_sources": mixing.ORACLE, "op9_secret_scan": SECRETS,
    "op11_filter_audit": filter_audit.ORACLE, "op12_exact_dedup": exact_dedup.ORACLE, "op13_conversation_repair": repair.ORACLE,
}
