"""Queries for the ordered folds (PAK-*) and their recursive-SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing
from ..sources import fixtures as fx
from .catalog import register
from .oracle_fixtures import with_fixtures

MAX_BATCH_BYTES = 100_000
ORDER = ("ts", "okey", "lno", "pkey", "skey")
MAX_LINES, MAX_BYTES, TIMEOUT_S = 50, 4000, 3 * 3600
QUOTA = 150_000


def _pack(spark, sf):
    raw = fx.raw_sizes(spark, sf)
    return packing.pack_by_size(raw, order=ORDER, max_batch_bytes=MAX_BATCH_BYTES, keep_sizes=True), raw


@register("pak01_size_packing", with_fixtures(f"""
WITH RECURSIVE items AS (
  SELECT tenant_id, dataset_id, data_hint, size AS len,
    size + CASE WHEN data_hint IN ('ndjson','csv','tsv','syslog','apache','nginx','iis','squid')
                 AND size > 0 AND NOT ends_nl THEN 1 ELSE 0 END AS w,
    row_number() OVER (PARTITION BY tenant_id, dataset_id, data_hint ORDER BY ts, okey, lno, pkey, skey) AS rn
  FROM raw_sizes),
r AS (
  SELECT tenant_id, dataset_id, data_hint, rn, w, w AS acc, CAST(0 AS BIGINT) AS batch_no FROM items WHERE rn = 1
  UNION ALL
  SELECT i.tenant_id, i.dataset_id, i.data_hint, i.rn, i.w,
    CASE WHEN r.acc > 0 AND (r.acc + i.len) // 5 > {MAX_BATCH_BYTES} THEN i.w ELSE r.acc + i.w END,
    CASE WHEN r.acc > 0 AND (r.acc + i.len) // 5 > {MAX_BATCH_BYTES} THEN r.batch_no + 1 ELSE r.batch_no END
  FROM r JOIN items i ON i.tenant_id = r.tenant_id AND i.dataset_id = r.dataset_id
                     AND i.data_hint = r.data_hint AND i.rn = r.rn + 1)
SELECT tenant_id, dataset_id, data_hint, batch_no, count(*) AS files, CAST(sum(w) AS BIGINT) AS bytes
FROM r GROUP BY ALL"""))
def q_size_packing(spark, sf):
    """PAK-01: greedy 5:1-estimated size packing per (tenant, dataset, hint)."""
    assign, _ = _pack(spark, sf)
    keys = ["tenant_id", "dataset_id", "data_hint"]
    return assign.groupBy(*keys, "batch_no").agg(F.count(F.lit(1)).alias("files"), F.sum("w").cast("long").alias("bytes"))


def _trigger_input(spark, sf):
    m = fx.messages(spark, sf)
    return m.select("tenant_id", "dataset_id", "ts", "seq", F.octet_length("data").cast("long").alias("size"))


PAK02_SQL = with_fixtures(f"""
WITH RECURSIVE items AS (
  SELECT tenant_id, dataset_id, ts, epoch_us(ts) AS tus, CAST(strlen(data) AS BIGINT) AS len,
    row_number() OVER (PARTITION BY tenant_id, dataset_id ORDER BY ts, seq) AS rn
  FROM messages),
r AS (
  SELECT tenant_id, dataset_id, rn, tus, CAST(0 AS BIGINT) AS bn, CAST(1 AS BIGINT) AS cnt, len AS byt,
    CASE WHEN 1 >= {MAX_LINES} THEN 1 WHEN len >= {MAX_BYTES} THEN 2 ELSE 0 END AS cl
  FROM items WHERE rn = 1
  UNION ALL
  SELECT tenant_id, dataset_id, rn, tus, bn, cnt, byt,
    CASE WHEN cnt >= {MAX_LINES} THEN 1 WHEN byt >= {MAX_BYTES} THEN 2 ELSE 0 END
  FROM (SELECT i.tenant_id, i.dataset_id, i.rn, i.tus,
          CASE WHEN r.cl > 0 THEN r.bn + 1 WHEN i.tus - r.tus > CAST({TIMEOUT_S} AS BIGINT) * 1000000 THEN r.bn + 1 ELSE r.bn END AS bn,
          CASE WHEN r.cl > 0 OR i.tus - r.tus > CAST({TIMEOUT_S} AS BIGINT) * 1000000 THEN 1 ELSE r.cnt + 1 END AS cnt,
          CASE WHEN r.cl > 0 OR i.tus - r.tus > CAST({TIMEOUT_S} AS BIGINT) * 1000000 THEN i.len ELSE r.byt + i.len END AS byt
        FROM r JOIN items i ON i.tenant_id = r.tenant_id AND i.dataset_id = r.dataset_id AND i.rn = r.rn + 1)),
per AS (SELECT r.tenant_id, r.dataset_id, r.bn AS batch_no, count(*) AS messages, CAST(sum(i.len) AS BIGINT) AS bytes,
          min(i.ts) AS first_ts, max(i.ts) AS last_ts, max(r.cl) AS cl
        FROM r JOIN items i USING (tenant_id, dataset_id, rn) GROUP BY ALL)
SELECT p.tenant_id, p.dataset_id, p.batch_no, p.messages, p.bytes, p.first_ts, p.last_ts,
  CASE WHEN p.cl = 1 THEN 'line_limit_reached' WHEN p.cl = 2 THEN 'size_limit_reached'
       WHEN n.batch_no IS NOT NULL THEN 'timeout' ELSE 'service_shutdown' END AS trigger_reason
FROM per p LEFT JOIN per n ON n.tenant_id = p.tenant_id AND n.dataset_id = p.dataset_id AND n.batch_no = p.batch_no + 1""")


@register("pak02_trigger_packing", PAK02_SQL)
def q_trigger_packing(spark, sf):
    """PAK-02: line / byte / idle-gap triggers per (tenant, dataset)."""
    return packing.pack_by_triggers(_trigger_input(spark, sf), max_lines=MAX_LINES, max_bytes=MAX_BYTES,
                                    timeout_s=TIMEOUT_S)


@register("pak03_quota_admission", with_fixtures(f"""
WITH RECURSIVE items AS (
  SELECT tenant_id, seq, CAST(strlen(data) AS BIGINT) AS size,
    CAST(substring(tenant_id, 7) AS BIGINT) * 10000 AS cur,
    row_number() OVER (PARTITION BY tenant_id ORDER BY ts, seq) AS rn
  FROM messages),
r AS (
  SELECT tenant_id, rn, seq, cur + size <= {QUOTA} AS admitted,
    CASE WHEN cur + size <= {QUOTA} THEN size ELSE 0 END AS used FROM items WHERE rn = 1
  UNION ALL
  SELECT i.tenant_id, i.rn, i.seq, i.cur + r.used + i.size <= {QUOTA},
    CASE WHEN i.cur + r.used + i.size <= {QUOTA} THEN r.used + i.size ELSE r.used END
  FROM r JOIN items i ON i.tenant_id = r.tenant_id AND i.rn = r.rn + 1)
SELECT tenant_id, seq, admitted FROM r"""))
def q_quota_admission(spark, sf):
    """PAK-03: per-tenant quota admission of incoming writes."""
    m = fx.messages(spark, sf).select(
        "tenant_id", "ts", "seq", F.octet_length("data").cast("long").alias("size"),
        (F.substring("tenant_id", 7, 10).cast("long") * 10000).alias("current_bytes"))
    return packing.quota_admission(m, max_bytes=QUOTA).select("tenant_id", "seq", "admitted")
