"""DuckDB twins of ``tidewater.sources.fixtures`` for the oracle SQL.

Each entry is one CTE body over the driver tables; ``with_fixtures`` adds
the CTEs a statement needs (with their dependencies) in front of it.
"""

from __future__ import annotations

import re

_TXT = "('user=' || user_id || ' type=' || event_type || ' value=' || CAST(round(value * 100) AS BIGINT))"
_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]*"

CTE: dict[str, str] = {
    "messages": f"""
SELECT event_id AS seq,
  'in' || (user_id % 4) AS input,
  CASE user_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN '' WHEN 2 THEN 'ndjson' ELSE 'text' END AS data_format,
  'tenant' || (user_id % 7) AS tenant_id,
  event_type AS dataset_id,
  ts,
  CASE event_id % 5 WHEN 0 THEN props
    WHEN 1 THEN {_TXT}
    WHEN 2 THEN props || chr(10) || props
    WHEN 3 THEN {_TXT} || chr(10) || '  ' || chr(9) || chr(10) || props
    ELSE '{{"Ingest_Ms": ' || event_id || ', "INGEST_MS": ' || user_id || ', "k": ' || (user_id % 100) || '}}' END AS data,
  CASE event_id % 4 WHEN 0 THEN 'ndjson' WHEN 1 THEN 'text' WHEN 2 THEN 'csv' ELSE 'apache' END AS data_hint,
  '10.0.' || (user_id % 4) || '.' || (user_id % 250) AS source_ip
FROM events""",
    # FMT-01 over messages.
    "lines": f"""
SELECT m.seq, m.input, m.data_format, m.tenant_id, m.dataset_id, m.ts, m.data_hint, m.source_ip,
  t.pos - 1 AS line_no, t.line
FROM messages m, unnest(string_split(m.data, chr(10))) WITH ORDINALITY AS t(line, pos)
WHERE NOT regexp_full_match(t.line, '{_WS}')""",
    # FMT-06 memo: first auto-mode line per key.
    "detect": """
SELECT input, tenant_id, dataset_id, json_valid(line) AS detected_json
FROM lines
WHERE data_format NOT IN ('ndjson', 'text')
QUALIFY row_number() OVER (PARTITION BY input, tenant_id, dataset_id ORDER BY seq, line_no) = 1""",
    "landed": """
SELECT l.*,
  CASE WHEN l.data_format = 'ndjson' THEN false WHEN l.data_format = 'text' THEN true
       ELSE NOT d.detected_json END AS wrapped
FROM lines l LEFT JOIN detect d USING (input, tenant_id, dataset_id)""",
    "stamped": """
SELECT *, data_hint IN ('ndjson', 'json')
   AND (wrapped OR CASE WHEN json_valid(trim(line)) THEN json_type(trim(line)) = 'OBJECT' ELSE false END) AS is_stamped
FROM landed""",
}

DEPS: dict[str, tuple[str, ...]] = {
    "lines": ("messages",),
    "detect": ("lines",),
    "landed": ("lines", "detect"),
    "stamped": ("landed",),
}



def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, ()):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it names (and their deps)."""
    if not names:
        names = tuple(n for n in CTE if re.search(rf"\b{n}\b", sql))
    if not names:
        return sql.strip()
    parts = [f"{n} AS ({CTE[n].strip()})" for n in _closure(names)]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body

CTE.update({
    "doc_messages": "SELECT doc_id AS seq, lang AS tenant_id, source AS dataset_id, text AS data FROM documents",
    # Telemetry payloads: compact object, text, pretty-printed object, array.
    "telemetry": r"""
SELECT event_id, CASE event_id % 4
    WHEN 0 THEN props
    WHEN 1 THEN 'user ' || user_id || ' ' || event_type
    WHEN 2 THEN '{' || chr(10) || '  "k": ' || user_id || ',' || chr(10) || '  "t": "' || event_type || ' \"x\" y",' || chr(10) || '  "n": [1, 2]' || chr(10) || '}'
    ELSE CASE event_id % 20 WHEN 3 THEN ' null ' WHEN 7 THEN chr(0) || props || ' ' WHEN 11 THEN '   '
         ELSE '[' || user_id || ', 2]' END END AS data
FROM events""",
})

CTE.update({
    "syslog_messages": r"""
SELECT event_id AS seq, ts, '10.0.' || (user_id % 4) || '.' || (user_id % 250) AS source_ip,
  CASE event_id % 4
    WHEN 0 THEN '<' || (event_id % 192) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' host' || (user_id % 10) || ' '
                || event_type || ' ' || user_id || ' ID' || (event_id % 50) || ' [ex@32473 iut="3"] '
                || 'user ' || user_id || ' did ' || event_type
    WHEN 1 THEN '<' || (event_id % 192) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' host' || (user_id % 10) || ' '
                || event_type || ' - - - ' || 'user ' || user_id || ' did ' || event_type
    WHEN 2 THEN '<' || (event_id % 192) || '>' || strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ')
                || ' ' || strftime(ts, '%H:%M:%S') || ' host' || (user_id % 10) || ' ' || event_type || '['
                || user_id || ']: ' || 'user ' || user_id || ' did ' || event_type
    ELSE 'plain user ' || user_id || ' did ' || event_type END AS data
FROM events""",
})

CTE.update({
    "spool_files": """
SELECT tenant_id || '--' || dataset_id || '--' || okey || '--' || data_hint AS id, *,
  tenant_id || '/' || dataset_id || '/' || state || '/' || tenant_id || '--' || dataset_id || '--' || okey || '--' || data_hint || '.gz' AS path
FROM (SELECT o_orderkey AS okey,
  'tenant' || (o_custkey % 11) AS tenant_id,
  'ds' || substring(o_orderpriority, 1, 1) AS dataset_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'ndjson' WHEN 1 THEN 'raw' ELSE 'csv' END AS data_hint,
  CASE o_orderstatus WHEN 'O' THEN 'queue' WHEN 'F' THEN 'dlq' ELSE 'retry' END AS state,
  CASE WHEN o_orderkey % 50 = 0 THEN 'success' WHEN o_orderstatus = 'O' THEN 'pending'
       WHEN o_orderstatus = 'F' THEN 'dlq' ELSE 'retry' END AS status,
  CAST(round(o_totalprice) AS BIGINT) AS size,
  o_orderdate AS created_at,
  o_orderdate + to_seconds(o_orderkey) AS mod_time,
  CAST(o_orderkey % 7 AS INT) AS retry_count,
  CAST(o_orderkey % 1000 + 1 AS INT) AS line_count,
  'tok' || (o_custkey % 3) AS bearer_token,
  CASE o_orderkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'size_limit_reached'
       WHEN 2 THEN 'service_shutdown' ELSE 'line_limit_reached' END AS trigger_reason,
  CASE o_orderstatus WHEN 'F' THEN 'Exceeded retry limit' WHEN 'P' THEN 'HTTP 503' ELSE '' END AS failure_reason
FROM orders)""",
    "spool_listing": """
SELECT path, size AS length, mod_time AS modificationTime FROM spool_files WHERE okey % 13 <> 0
UNION ALL
SELECT tenant_id || '/' || dataset_id || '/' || state || '/' || id || '.meta', CAST(200 + okey % 50 AS BIGINT), mod_time
FROM spool_files WHERE state IN ('retry', 'dlq')""",
    "attempts": """
SELECT l_orderkey AS okey,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS attempt_no,
  CAST(CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 401
       WHEN 4 THEN 404 WHEN 5 THEN 413 WHEN 6 THEN 429 WHEN 7 THEN 500 WHEN 8 THEN 503 ELSE NULL END AS INT) AS status_code,
  l_shipdate AS ts
FROM lineitem""",
    "tenants": """
SELECT 'tenant' || (n_nationkey + CASE WHEN n_nationkey >= 10 THEN 1 ELSE 0 END) AS tenant_id,
  CAST(CASE WHEN n_nationkey = 5 THEN 404 WHEN n_nationkey = 6 THEN 500 ELSE 200 END AS INT) AS status_code,
  CASE WHEN n_nationkey = 5 OR n_nationkey = 6 THEN NULL ELSE n_nationkey % 4 <> 3 END AS active
FROM nation""",
})
DEPS.update({"spool_listing": ("spool_files",)})

CTE.update({
    "listing_p": """
SELECT path, length, modificationTime, split_part(path, '/', 1) AS tenant_id, split_part(path, '/', 2) AS dataset_id,
  split_part(path, '/', 3) AS state, split_part(path, '/', 4) AS file, suffix(path, '.meta') AS is_meta
FROM spool_listing""",
})
DEPS.update({"listing_p": ("spool_listing",)})

OUTCOME_SQL = """(CASE WHEN {c} IS NULL THEN 'transient' WHEN {c} BETWEEN 200 AND 299 THEN 'success'
  WHEN {c} IN (400, 401, 403, 404, 410, 413, 422) THEN 'permanent' WHEN {c} = 429 THEN 'transient'
  WHEN {c} BETWEEN 400 AND 499 THEN 'permanent' ELSE 'transient' END)"""
REASON_SQL = """(CASE WHEN {c} IS NULL THEN 'no response: network error'
  ELSE 'receiver answered ' || {c} || ': no response body' END)"""
GATE_SQL = "coalesce(NOT (t.status_code IN (404, 410) OR (t.status_code = 200 AND t.active = false)), true)"


def outcome_sql(c: str) -> str:
    return OUTCOME_SQL.format(c=c)


def reason_sql(c: str) -> str:
    return REASON_SQL.format(c=c)

CTE.update({
    "raw_sizes": """
SELECT 't' || (l_suppkey % 10) AS tenant_id, l_returnflag AS dataset_id,
  CASE l_linestatus WHEN 'O' THEN 'ndjson' ELSE 'raw' END AS data_hint,
  l_shipdate AS ts, l_orderkey AS okey, l_linenumber AS lno, l_partkey AS pkey, l_suppkey AS skey,
  CAST(round(l_extendedprice) AS BIGINT) AS size, (l_orderkey + l_linenumber) % 2 = 0 AS ends_nl
FROM lineitem""",
})

_SEG = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'udp' WHEN 'BUILDING' THEN 'syslog' WHEN 'FURNITURE' THEN 'http' "
        "WHEN 'MACHINERY' THEN 'kafka' ELSE '' END")
CTE.update({
    # JON-01 result, flattened: one row per active dataset with a source type.
    "configs_flat": f"""
SELECT {_SEG} AS type, 'Set ' || c_custkey || '-' || n_name AS name, c_custkey AS pos,
  CASE WHEN c_custkey % 13 = 0 THEN 'override' || c_custkey ELSE 'tenant' || n_nationkey END AS tenant_id,
  'ds' || c_custkey AS dataset_id, 'global-token' AS bearer_token, CAST(1024 + c_custkey % 600 AS VARCHAR) AS port,
  '0.0.0.0' AS host
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey % 4 <> 0 AND {_SEG} <> ''""",
    "local_inputs": f"""
SELECT c_custkey AS pos, {_SEG} AS type, 'in' || c_custkey AS name,
  CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'Admin' ELSE 'ds' || (c_custkey % 400) END AS dataset_id,
  CASE WHEN c_custkey % 23 = 0 THEN 'x' WHEN c_custkey % 29 = 0 THEN '70000' ELSE CAST(1024 + c_custkey % 700 AS VARCHAR) END AS port,
  CASE WHEN c_custkey % 3 = 0 THEN 'tenant' || (c_custkey % 5) END AS tenant_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'tok' || c_custkey END AS bearer_token,
  CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey * 7 AS VARCHAR) END AS buffer_size
FROM customer""",
    "old_ports": f"SELECT c_custkey AS pos, CAST(1024 + c_custkey % 900 AS INT) AS port, {_SEG} || '[ds' || c_custkey || ']' AS plugin FROM customer",
    "new_ports": f"""
SELECT c_custkey AS pos, CAST(1024 + c_custkey % 950 AS INT) AS port,
  {_SEG} || '[ds' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '-v2' ELSE '' END || ']' AS plugin
FROM customer WHERE c_custkey % 9 <> 0
UNION ALL
SELECT c_custkey, CAST(20000 + c_custkey AS INT), {_SEG} || '[extra' || c_custkey || ']' FROM customer WHERE c_custkey % 5 = 0""",
    "instances": """
SELECT 'inst' || n_nationkey AS instance, 'http://host' || (n_nationkey * 4) || ':' || (8000 + n_nationkey % 7) || '/' AS receiver_url,
  CAST(CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5000000 ELSE 50000000 END AS BIGINT) AS max_bytes
FROM nation""",
    "receivers": """
SELECT s_suppkey AS pos, 'host' || s_suppkey || ':' || (8000 + s_suppkey % 5) AS instance_api,
  CASE WHEN s_suppkey = 0 THEN 0 ELSE CAST(round(s_acctbal * 1000) AS BIGINT) END AS max_payload_size
FROM supplier""",
    "poll_log": """
SELECT event_id, ts, 'inst' || (user_id % 8) AS instance,
  CAST(CASE event_type WHEN 'click' THEN 200 WHEN 'error' THEN 401 WHEN 'signup' THEN 403 WHEN 'view' THEN 404 ELSE 500 END AS INT) AS status,
  props AS config
FROM events""",
})

CTE.update({
    "port_counters": """
SELECT event_id, ts, CAST(1000 + user_id % 6 AS INT) AS port,
  CAST(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 0
       ELSE sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY 1000 + user_id % 6 ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS BIGINT) AS drops
FROM events""",
    "host_counters": """
SELECT event_id, ts, host,
  CAST(sum(u) OVER w AS BIGINT) AS "user", CAST(sum(s) OVER w AS BIGINT) AS system,
  CAST(count(*) OVER w * 10 AS BIGINT) AS idle, CAST(sum(io) OVER w AS BIGINT) AS iowait
FROM (SELECT event_id, ts, 'host' || (user_id % 5) AS host,
        CASE WHEN event_type IN ('click', 'view') THEN CAST(round(value) AS BIGINT) ELSE 0 END AS u,
        CASE WHEN event_type = 'error' THEN CAST(round(value) AS BIGINT) ELSE 0 END AS s,
        CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END AS io FROM events)
WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "error_reports": """
SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN 'resolve' ELSE 'report' END AS kind,
  'type' || (user_id % 3) AS error_type, 'ds' || (user_id % 5) AS dataset_id, 'tenant' || (user_id % 7) AS tenant_id,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity,
  event_type || ' from user ' || user_id AS message
FROM events""",
})

CTE.update({
    "http_requests": """
SELECT page_id AS seq, CASE WHEN page_id % 6 = 5 THEN 'GET' ELSE 'POST' END AS method, '/ingest' AS path,
  CASE WHEN page_id % 7 = 3 THEN 'Bearer bad' ELSE 'Bearer secret' END AS auth_header,
  url AS x_source, 'r' || page_id AS x_request_id, 'ua/' || (page_id % 3) AS user_agent,
  CAST(CASE WHEN page_id % 11 = 0 THEN 100 ELSE strlen(html) END AS BIGINT) AS declared_length, html AS body
FROM pages""",
    "raw_names": """
SELECT l_orderkey AS okey, l_linenumber AS lno, l_partkey AS pkey,
  CASE l_linenumber % 6
    WHEN 0 THEN n || '.ndjson' WHEN 1 THEN n || '.log' WHEN 2 THEN n || '.csv' WHEN 3 THEN n || '.txt'
    WHEN 4 THEN n ELSE 'old_' || l_orderkey || '.xml' END AS name,
  CAST(l_quantity AS INT) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS actual_lines
FROM (SELECT *, CAST(epoch_us(l_shipdate) * 1000 + l_partkey AS VARCHAR) || '_' || CAST(round(l_extendedprice) AS BIGINT)
              || '_' || CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS n
      FROM lineitem)""",
})


def _hx(expr: str, width: int = 2) -> str:
    return f"lpad(hex({expr}), {width}, '0')"


# Rendered expectations of the flow fixtures (computed from the formulas,
# not from the bytes, so the byte decoding is what the oracle checks).
CTE.update({
    "sflow_expected": """
SELECT o_orderkey AS packet_id, l_linenumber AS lno, l_partkey AS pkey, l_suppkey AS skey,
  5 AS version, '10.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || '.1' AS agent_ip,
  100 + o_orderkey % 7 AS sampling_rate, o_orderkey % 48 AS input_if, o_custkey % 48 AS output_if,
  CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 6 WHEN k = 2 AND o_orderkey % 5 <> 0 THEN 17 END AS protocol,
  CASE WHEN k = 0 THEN 64 + l_linenumber END AS frame_length,
  CASE WHEN k = 0 AND v IN (0, 1) THEN (CASE WHEN v = 0 THEN '10' ELSE '69' END) || '.' || (l_partkey % 256) || '.' || (l_suppkey % 256) || '.' || l_linenumber
       WHEN k = 1 THEN '172.16.' || (l_partkey % 256) || '.' || (l_suppkey % 256)
       WHEN k = 2 AND o_orderkey % 5 <> 0 THEN CASE WHEN l_partkey % 65536 = 0 THEN '2001:db8::' ELSE '2001:db8::' || lower(printf('%x', l_partkey % 65536)) END END AS src_ip,
  CASE WHEN k = 0 AND v IN (0, 1) THEN '192.168.' || (l_orderkey % 256) || '.' || (l_partkey % 200)
       WHEN k = 1 THEN '172.17.' || (l_orderkey % 256) || '.' || l_linenumber
       WHEN k = 2 AND o_orderkey % 5 <> 0 THEN '2001:db8::1' END AS dst_ip,
  CASE WHEN k = 0 AND v IN (0, 1) AND l_partkey % 3 IN (0, 1) AND l_suppkey % 7 <> 0 AND l_partkey % 65536 <> 0 THEN l_partkey % 65536
       WHEN k = 1 OR (k = 2 AND o_orderkey % 5 <> 0) THEN l_partkey % 65536 END AS src_port,
  CASE WHEN k = 0 AND v IN (0, 1) AND l_partkey % 3 IN (0, 1) AND (l_suppkey * 7) % 65536 <> 0 THEN (l_suppkey * 7) % 65536
       WHEN k = 1 OR (k = 2 AND o_orderkey % 5 <> 0) THEN 443 END AS dst_port
FROM (SELECT *, l_linenumber % 4 AS k, (l_partkey // 3) % 4 AS v FROM lineitem) l
JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey % 11 <> 0""",
})

# What the datagrams of the documents hold: sound ones, the layout and the
# sampling rate in force, and the four words of each record.
CTE.update({
    "wire_packets": """
SELECT *, last_value(told IGNORE NULLS) OVER (PARTITION BY src, v9, domain ORDER BY doc_id) AS layout,
  last_value(rate IGNORE NULLS) OVER (PARTITION BY src, v9, domain ORDER BY doc_id) AS sampling
FROM (SELECT doc_id, coalesce(source, '') AS src, coalesce(n_chars, 0) AS n, doc_id % 2 = 0 AS v9, doc_id // 2 % 3 AS domain,
        CASE WHEN doc_id % 89 = 3 THEN 'version' WHEN doc_id % 97 <> 5 THEN NULL WHEN doc_id % 2 = 0 THEN 'set length' ELSE 'short' END AS error,
        CASE WHEN doc_id % 7 = 0 AND error IS NULL THEN doc_id // 7 % 2 END AS told,
        CASE WHEN doc_id % 21 = 0 AND error IS NULL THEN 100 + doc_id % 900 END AS rate,
        array_to_string(list_transform([1, 3, 5, 7], lambda i: ('0x' || md5(coalesce(source, ''))[i:i + 1])::BIGINT), '.') AS exporter
      FROM documents WHERE doc_id IS NOT NULL)""",
    "wire_words": """
SELECT *, r - 1 AS record_no, 167772160 + (doc_id * 31 + r) % 16777216 AS w0, 3232235520 + (doc_id + r * 7) % 65536 AS w1,
  (doc_id * 13 + r) % 65536 * 65536 + 443 AS w2, (n * 97 + r * 1500) % 2147483648 AS w3
FROM (SELECT *, unnest(range(1, 2 + n % 23)) AS r FROM wire_packets WHERE error IS NULL AND layout IS NOT NULL)""",
})
DEPS.update({"wire_words": ("wire_packets",)})
