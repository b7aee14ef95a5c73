"""DuckDB SQL for the conversation repair and the Merkle manifest.

SQL has no CRC-32 here, so both compute it byte by byte from a table.
"""

from __future__ import annotations

CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def crc(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text; needs ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    step = "lambda c, b: xor(crc_table.t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {step}), 4294967295)"


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE}, rows AS (
  SELECT doc_id, lang, row_number() OVER () AS no, coalesce({crc("doc_id::VARCHAR")} % 3 = 0, false) AS taken,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM documents, crc_table
), hashed AS (
  SELECT doc_id, lang, no, sha256(head || body) AS leaf, sha256(head || CASE WHEN taken THEN low ELSE body END) AS seen FROM rows
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, no) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM hashed
), low_nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
  FROM low_nodes WHERE n > 1 GROUP BY lang, lvl, pos // 8, n
), subroots AS (
  SELECT lang, lvl, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM low_nodes WHERE n = 1
), top_nodes AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
  FROM top_nodes WHERE n > 1 GROUP BY lvl, pos // 8, n
), nodes AS (
  SELECT false AS top, lang, lvl, pos, h FROM low_nodes
  UNION ALL SELECT true, NULL, lvl, pos, h FROM top_nodes
), runs AS (
  SELECT top, lang, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY ALL
), root AS (SELECT h AS root FROM top_nodes WHERE n = 1
), walk AS (
  SELECT l.lang, l.no, false AS top, 0 AS lvl, l.pos, l.seen AS h, '' AS proof, s.lvl AS last, s.pos AS place
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.lang, w.no, w.top OR w.lvl = w.last, CASE WHEN NOT w.top AND w.lvl = w.last THEN 0 ELSE w.lvl + 1 END,
         CASE WHEN NOT w.top AND w.lvl = w.last THEN w.place ELSE w.pos // 8 END,
         CASE WHEN NOT w.top AND w.lvl = w.last THEN w.h
              ELSE sha256(array_to_string(r.hs[1:w.pos % 8] || [w.h] || r.hs[w.pos % 8 + 2:], '')) END,
         CASE WHEN NOT w.top AND w.lvl = w.last THEN w.proof
              ELSE w.proof || array_to_string(r.hs[1:w.pos % 8] || r.hs[w.pos % 8 + 2:], '') END, w.last, w.place
  FROM walk w JOIN runs r ON r.top = w.top AND (w.top OR r.lang IS NOT DISTINCT FROM w.lang) AND r.lvl = w.lvl AND r.run = w.pos // 8
  WHERE NOT w.top OR w.lvl < (SELECT max(lvl) FROM top_nodes)
)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root.root AS verified
FROM walk w JOIN leaves l ON l.no = w.no JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, root
WHERE w.top AND w.lvl = (SELECT max(lvl) FROM top_nodes)
"""


def add(label: str, cost: object, edit: str) -> str:
    """SQL for a label (nine digits of cost, then the edits) with one more edit."""
    return f"lpad((({label})[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || ({label})[10:] || '{edit}'"


# Labels by state (start, s, u, a) are st[1..4]; insertions first.
CLOSED_U = f"list_min([st[3], {add('st[1]', 5, 'I')}, {add('st[2]', 5, 'I')}, {add('st[4]', 5, 'I')}])"
CLOSED_A = f"list_min([st[4], {add('st[3]', 5, 'I')}, {add('st[1]', 10, 'II')}, {add('st[2]', 10, 'II')}])"
CLOSED = f"[st[1], st[2], {CLOSED_U}, {CLOSED_A}]"
# A turn t: its extra cost (NULL: it must go) and its initial.
STEP = f"""[{add('st[1]', 2, 'D')},
  list_min([{add('st[2]', 2, 'D')}, CASE WHEN t[2] = 's' THEN {add('st[1]', 't[1]::BIGINT', 'K')} END]),
  list_min([{add('st[3]', 2, 'D')}] || list_transform([st[1], st[2], st[4]], lambda x: {add('x', '1 + t[1]::BIGINT', 'R')})
    || list_transform([st[1], st[2], st[4]], lambda x: CASE WHEN t[2] = 'u' THEN {add('x', 't[1]::BIGINT', 'K')} END)),
  list_min([{add('st[4]', 2, 'D')}, {add('st[3]', '1 + t[1]::BIGINT', 'R')}, CASE WHEN t[2] = 'a' THEN {add('st[3]', 't[1]::BIGINT', 'K')} END])]"""
# Applying the edits e; the state w: what came last, the next turn, the text.
PUT = "CASE WHEN w[3] IS NULL THEN '' ELSE w[3] || chr(10) END"
THEN_STATE = "CASE WHEN w[1] = 'u' THEN 'a' ELSE 'u' END"
THEN_ROLE = "CASE WHEN w[1] = 'u' THEN 'assistant' ELSE 'user' END"
WALK = f"""CASE e[1] WHEN 'D' THEN [w[1], (w[2]::BIGINT + 1)::VARCHAR, w[3]]
  WHEN 'I' THEN [{THEN_STATE}, w[2], {PUT} || {THEN_ROLE} || ':']
  WHEN 'R' THEN [{THEN_STATE}, (w[2]::BIGINT + 1)::VARCHAR, {PUT} || {THEN_ROLE} || ':' || texts[w[2]::BIGINT]]
  ELSE [roles[w[2]::BIGINT][1:1], (w[2]::BIGINT + 1)::VARCHAR, {PUT} || roles[w[2]::BIGINT] || ':' || texts[w[2]::BIGINT]] END"""
REPAIR = f"""
WITH {CRC_TABLE}, coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code
  FROM conversations, crc_table
), rows AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE code > 0
), told AS (
  SELECT *, sha256(strlen(role) || ':' || role || text) AS digest, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth
  FROM rows
), marked AS (
  SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate, bare <> '' AND nth = 1 AND bare[-1:] NOT IN ('.', '!', '?') AS truncated,
         lag(role[1:1]) OVER w || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, nth)
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (illegal) AS illegal,
         list([CASE WHEN blank OR duplicate THEN NULL WHEN truncated THEN '5' ELSE '0' END, role[1:1]] ORDER BY turn NULLS FIRST, role, digest, nth) AS turns,
         list(role ORDER BY turn NULLS FIRST, role, digest, nth) AS roles, list(text ORDER BY turn NULLS FIRST, role, digest, nth) AS texts
  FROM marked GROUP BY conv_id
), solved AS (
  SELECT *, list_reduce(turns, lambda s, t: list_extract(list_transform([{CLOSED.replace('st[','s[')}], lambda st: {STEP}), 1), ['000000000', NULL, NULL, NULL]) AS st FROM found
), best AS (SELECT *, list_min([st[1], {CLOSED_A}]) AS best FROM solved
), walked AS (
  SELECT *, best[10:] AS audit, list_reduce(list_transform(string_split(best[10:], ''), lambda c: [c]), lambda w, e: {WALK}, ['', '1', NULL])[3] AS repaired FROM best
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[1:9]::BIGINT, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN walked w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
"""
