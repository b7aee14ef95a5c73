"""Queries for monitoring windows and traffic aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.naming import delivery_outcome
from ..operators import delivery, monitor, packing
from ..sources import fixtures as fx
from .catalog import register
from .oracle_fixtures import outcome_sql, with_fixtures

AS_OF = "2024-02-01 00:00:00"


def _failed_attempts(spark, sf):
    a = fx.attempts(spark, sf)
    return a.where(delivery_outcome(F.col("status_code")) != "success").withColumn(
        "instance", F.concat(F.lit("inst"), (F.col("okey") % 4).cast("string")))


@register("win01_rolling_errors", with_fixtures(f"""
SELECT instance, okey, attempt_no, count(*) OVER (PARTITION BY instance ORDER BY ts
    RANGE BETWEEN INTERVAL 86399999 MICROSECONDS PRECEDING AND CURRENT ROW) AS count_24h
FROM (SELECT *, 'inst' || (okey % 4) AS instance FROM attempts WHERE {outcome_sql('status_code')} <> 'success')"""))
def q_rolling_errors(spark, sf):
    """WIN-01: forwarding errors in the trailing 24 h at each error."""
    return monitor.rolling_count(_failed_attempts(spark, sf), ["instance"], "ts", ["okey", "attempt_no"])


@register("win02_port_drops", with_fixtures("""
SELECT port, event_id, drops,
  CAST(CASE WHEN drops > lag(drops, 1, 0) OVER w THEN drops - lag(drops, 1, 0) OVER w ELSE 0 END AS BIGINT) AS new_drops,
  drops = 0 AND lag(drops, 1, 0) OVER w > 0 AS resolved
FROM port_counters WINDOW w AS (PARTITION BY port ORDER BY ts, event_id)"""))
def q_port_drops(spark, sf):
    """WIN-02: new drops per port reading and resolutions."""
    return monitor.port_drop_events(fx.port_counters(spark, sf))


@register("win03_service_status", with_fixtures("""
SELECT port AS instance, event_id,
  CASE WHEN running = 0 THEN 'unhealthy'
       WHEN drops > 0 AND base IS NOT NULL AND drops > base THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 0 ELSE 2 END AS running,
        last_value(CASE WHEN drops > 0 THEN drops END IGNORE NULLS) OVER (PARTITION BY port ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base
      FROM port_counters)"""))
def q_service_status(spark, sf):
    """WIN-03: healthy / degraded / unhealthy per reading."""
    r = fx.port_counters(spark, sf).select(
        F.col("port").alias("instance"), "event_id", "ts", "drops", F.lit(2).alias("expected"),
        F.when(F.col("event_id") % 97 == 0, 0).otherwise(2).alias("running"))
    return monitor.service_status(r)


@register("win04_cpu_usage", with_fixtures("""
SELECT host, event_id,
  CASE WHEN tot IS NOT NULL AND tot > 0 THEN CAST(tot - idl AS DOUBLE) / CAST(tot AS DOUBLE) * 100 ELSE 0.0 END AS cpu_used_pct,
  CASE WHEN tot IS NOT NULL AND tot > 0 THEN CAST(io AS DOUBLE) / CAST(tot AS DOUBLE) * 100 ELSE 0.0 END AS cpu_iowait_pct
FROM (SELECT host, event_id,
        ("user" - lag("user") OVER w) + (system - lag(system) OVER w) + (idle - lag(idle) OVER w) + (iowait - lag(iowait) OVER w) AS tot,
        (idle - lag(idle) OVER w) + (iowait - lag(iowait) OVER w) AS idl, iowait - lag(iowait) OVER w AS io
      FROM host_counters WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))"""))
def q_cpu_usage(spark, sf):
    """WIN-04: CPU used / iowait percentages from cumulative counters."""
    return monitor.cpu_usage(fx.host_counters(spark, sf))


@register("win07_error_queue", with_fixtures("""
SELECT event_id, coalesce(severity, 'error') AS severity FROM error_reports WHERE kind = 'report'
ORDER BY ts DESC, event_id DESC LIMIT 1000"""))
def q_error_queue(spark, sf):
    """WIN-07: bounded retry queue of reports (newest 1000 kept)."""
    return monitor.error_queue(fx.error_reports(spark, sf)).select("event_id", "severity")


@register("win07_open_errors", with_fixtures("""
SELECT r.error_type, r.dataset_id, coalesce(r.severity, 'error') AS severity, count(*) AS open_reports
FROM error_reports r LEFT JOIN (SELECT error_type, dataset_id, max(ts) AS rt FROM error_reports WHERE kind = 'resolve' GROUP BY ALL) x
  USING (error_type, dataset_id)
WHERE r.kind = 'report' AND (x.rt IS NULL OR r.ts > x.rt) GROUP BY ALL"""))
def q_open_errors(spark, sf):
    """WIN-07: reports not yet resolved by a (type, dataset) resolve event."""
    o = monitor.open_errors(fx.error_reports(spark, sf))
    return o.groupBy("error_type", "dataset_id", "severity").agg(F.count(F.lit(1)).alias("open_reports"))


@register("agg05_dataset_traffic", with_fixtures(f"""
WITH pf AS (SELECT okey, count(*) FILTER (WHERE {outcome_sql('status_code')} = 'success') AS ok,
              count(*) FILTER (WHERE {outcome_sql('status_code')} <> 'success') AS errors FROM attempts GROUP BY okey)
SELECT tenant_id, dataset_id, CAST(sum(ok) AS BIGINT) AS batches_forwarded, CAST(sum(size * ok) AS BIGINT) AS bytes_forwarded,
  CAST(sum(line_count * ok) AS BIGINT) AS lines_forwarded, CAST(sum(errors) AS BIGINT) AS errors
FROM spool_files JOIN pf USING (okey) GROUP BY ALL"""))
def q_dataset_traffic(spark, sf):
    """AGG-05: per-dataset forwarding metrics."""
    return monitor.dataset_traffic(fx.spool_files(spark, sf), fx.attempts(spark, sf))


@register("agg06_throughput", with_fixtures("""
SELECT input, messages, bytes, up AS uptime_s, CAST(bytes AS DOUBLE) / CAST(up AS DOUBLE) AS bytes_per_sec,
  CAST(messages AS DOUBLE) / CAST(up AS DOUBLE) AS messages_per_sec
FROM (SELECT input, count(*) AS messages, CAST(sum(strlen(data)) AS BIGINT) AS bytes,
        CAST(greatest((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000, 1) AS BIGINT) AS up
      FROM messages GROUP BY input)"""))
def q_throughput(spark, sf):
    """AGG-06: per-input throughput over its uptime."""
    m = fx.messages(spark, sf).withColumn("size", F.octet_length("data"))
    return monitor.throughput(m, "input", "ts", "size")


_CHECK = ("CASE WHEN status_code IS NULL THEN 'error' WHEN status_code BETWEEN 200 AND 299 THEN 'success' ELSE 'failed' END")


@register("agg08_check_summary", with_fixtures(f"""
SELECT instance, count(*) AS total, count(*) FILTER (WHERE s = 'success') AS success,
  count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'error') AS error,
  CAST(count(*) FILTER (WHERE s = 'success') * 100 // count(*) AS BIGINT) AS success_rate
FROM (SELECT 'inst' || (okey % 4) AS instance, {_CHECK} AS s FROM attempts) GROUP BY instance"""))
def q_check_summary(spark, sf):
    """AGG-08: connectivity check summary with integer success rate."""
    a = fx.attempts(spark, sf).select(
        F.concat(F.lit("inst"), (F.col("okey") % 4).cast("string")).alias("instance"),
        F.expr(_CHECK).alias("check_status"))
    return monitor.check_summary(a, "instance")


@register("agg09_retry_results", with_fixtures(f"""
SELECT tenant_id, CAST(grouping(tenant_id) AS INT) AS level, count(*) AS processed,
  count(*) FILTER (WHERE st = 'delivered') AS succeeded, count(*) FILTER (WHERE st = 'retry') AS failed,
  count(*) FILTER (WHERE st = 'dlq') AS to_dlq
FROM (SELECT f.tenant_id, CASE WHEN f.retry_count >= 5 THEN 'dlq' WHEN {outcome_sql('a.status_code')} = 'success' THEN 'delivered'
        ELSE 'retry' END AS st
      FROM spool_files f LEFT JOIN attempts a ON a.okey = f.okey AND a.attempt_no = f.retry_count + 1
      WHERE f.state = 'retry' AND (f.retry_count >= 5 OR a.okey IS NOT NULL))
GROUP BY ROLLUP (tenant_id)"""))
def q_retry_results(spark, sf):
    """AGG-09: retry pass results per tenant and in total."""
    f = fx.spool_files(spark, sf).where("state = 'retry'")
    a = fx.attempts(spark, sf)
    nxt = f.select("okey", (F.col("retry_count") + 1).alias("attempt_no")).join(a, ["okey", "attempt_no"], "inner")
    return monitor.retry_pass_results(delivery.retry_step(f, nxt.select("okey", "status_code", "ts")))


_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


@register("agg10_input_counters", with_fixtures(f"""
SELECT input, count(*) AS received, CAST(sum(strlen(data)) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE regexp_full_match(data, '{_WS}*')) AS dropped, max(ts) AS last_time
FROM messages GROUP BY input"""))
def q_input_counters(spark, sf):
    """AGG-10: per-input received / bytes / dropped / last time."""
    m = fx.messages(spark, sf).withColumn("size", F.octet_length("data"))
    return monitor.input_counters(m, ["input"], "ts", "size", T.is_blank("data"))


@register("agg11_metric_counters", with_fixtures(f"""
SELECT tenant_id, dataset_id, CASE WHEN waits THEN 'waiting' WHEN o = 'success' THEN 'success' WHEN o = 'permanent' THEN 'error'
    ELSE 'retry' END AS status,
  count(*) FILTER (WHERE NOT waits) AS requests, CAST(sum(CASE WHEN NOT waits AND o = 'success' THEN 0 ELSE 1 END) AS BIGINT) AS queue_gauge
FROM (SELECT f.tenant_id, f.dataset_id, a.okey IS NULL AS waits, {outcome_sql('a.status_code')} AS o
      FROM spool_files f LEFT JOIN attempts a ON a.okey = f.okey AND a.attempt_no = 1 WHERE f.state = 'queue')
GROUP BY ALL"""))
def q_metric_counters(spark, sf):
    """AGG-11: request counters by status and the queue gauge."""
    step = delivery.queue_step(fx.spool_files(spark, sf), fx.attempts(spark, sf).where("attempt_no = 1"))
    return monitor.metric_counters(step)


@register("agg12_histogram", with_fixtures("""
SELECT tenant_id, CASE WHEN line_count <= 0 THEN 0 WHEN line_count <= 5 THEN 1 WHEN line_count <= 10 THEN 2
  WHEN line_count <= 25 THEN 3 WHEN line_count <= 50 THEN 4 WHEN line_count <= 75 THEN 5 WHEN line_count <= 100 THEN 6
  WHEN line_count <= 250 THEN 7 WHEN line_count <= 500 THEN 8 WHEN line_count <= 750 THEN 9 WHEN line_count <= 1000 THEN 10
  WHEN line_count <= 2500 THEN 11 WHEN line_count <= 5000 THEN 12 WHEN line_count <= 7500 THEN 13
  WHEN line_count <= 10000 THEN 14 ELSE 15 END AS bucket,
  count(*) AS count, CAST(sum(line_count) AS BIGINT) AS sum, CAST(min(line_count) AS BIGINT) AS min, CAST(max(line_count) AS BIGINT) AS max
FROM spool_files GROUP BY ALL"""))
def q_histogram(spark, sf):
    """AGG-12: batch line-count histogram per tenant."""
    return monitor.histogram(fx.spool_files(spark, sf), ["tenant_id"], "line_count")


@register("agg11_received", with_fixtures("""
SELECT tenant_id, dataset_id, packets, bytes, coalesce(lines, 0) AS lines
FROM (SELECT tenant_id, dataset_id, count(*) AS packets, CAST(sum(strlen(data)) AS BIGINT) AS bytes FROM messages GROUP BY ALL)
LEFT JOIN (SELECT tenant_id, dataset_id, count(*) AS lines FROM lines GROUP BY ALL) USING (tenant_id, dataset_id)"""))
def q_received(spark, sf):
    """AGG-11: packets, bytes and lines received per dataset."""
    return monitor.received_counters(fx.messages(spark, sf))


@register("agg11_forwarded", with_fixtures(f"""
SELECT tenant_id, dataset_id, CAST(sum(CASE WHEN ok THEN size ELSE 0 END) AS BIGINT) AS bytes_forwarded,
  CAST(sum(CASE WHEN ok THEN line_count ELSE 0 END) AS BIGINT) AS lines_forwarded,
  CAST(sum(CASE WHEN ok THEN 0 ELSE size END) AS BIGINT) AS bytes_gauge
FROM (SELECT f.*, a.okey IS NOT NULL AND {outcome_sql('a.status_code')} = 'success' AS ok
      FROM spool_files f LEFT JOIN attempts a ON a.okey = f.okey AND a.attempt_no = 1 WHERE f.state = 'queue')
GROUP BY ALL"""))
def q_forwarded(spark, sf):
    """AGG-11: bytes and lines forwarded, and the byte gauge of the queue."""
    files = fx.spool_files(spark, sf)
    return monitor.forwarded_counters(files, delivery.queue_step(files, fx.attempts(spark, sf).where("attempt_no = 1")))


def _histogram_sql(value: str, source: str) -> str:
    bounds = " ".join(f"WHEN v <= {b} THEN {i}" for i, b in enumerate(monitor.HISTOGRAM_BOUNDS))
    return f"""
SELECT tenant_id, dataset_id, CASE {bounds} ELSE {len(monitor.HISTOGRAM_BOUNDS)} END AS bucket, count(*) AS count,
  CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max
FROM (SELECT tenant_id, dataset_id, CAST({value} AS BIGINT) AS v FROM {source}) GROUP BY ALL"""


@register("agg12_histogram_bytes", with_fixtures(_histogram_sql("size", "spool_files")))
def q_histogram_bytes(spark, sf):
    """AGG-12: batch size histogram per dataset."""
    return monitor.histogram(fx.spool_files(spark, sf), ["tenant_id", "dataset_id"], "size")


@register("agg12_histogram_duration", with_fixtures(_histogram_sql(
    "epoch(a.ts) - epoch(f.created_at)", "spool_files f JOIN attempts a ON a.okey = f.okey")))
def q_histogram_duration(spark, sf):
    """AGG-12: seconds from a batch's creation to each of its attempts, per
    dataset."""
    j = fx.spool_files(spark, sf).join(fx.attempts(spark, sf).select("okey", "ts"), "okey")
    s = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return monitor.histogram(j.withColumn("seconds", s), ["tenant_id", "dataset_id"], "seconds")


@register("agg12_size_percentiles", with_fixtures("""
SELECT tenant_id, true AS within FROM spool_files GROUP BY tenant_id"""))
def q_size_percentiles(spark, sf):
    """AGG-12: approximate batch-size quantiles per tenant; ``within`` tells
    whether their true ranks miss by at most 1 % of the tenant's rows."""
    f = fx.spool_files(spark, sf).select("tenant_id", "size")
    q = f.groupBy("tenant_id").agg(F.percentile_approx("size", [0.5, 0.9, 0.99], 10000).alias("p"))
    marks = q.select("tenant_id", F.posexplode("p").alias("i", "v"))
    ranks = f.join(marks, "tenant_id").groupBy("tenant_id", "i").agg(
        (F.count_if(F.col("size") < F.col("v")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col("size") <= F.col("v")) / F.count(F.lit(1))).alias("upto"))
    want = F.element_at(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("i") + 1)
    ok = (F.col("below") <= want + 0.01) & (F.col("upto") >= want - 0.01)
    return ranks.groupBy("tenant_id").agg(F.bool_and(ok).alias("within"))


def _open_batches_sql() -> str:
    from .packing_queries import PAK02_SQL
    return f"""
SELECT tenant_id, dataset_id, count(*) AS open_batches, CAST(sum(messages) AS BIGINT) AS messages,
  CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - epoch_us(min(first_ts)) // 1000000 AS age_s
FROM ({PAK02_SQL}) b WHERE trigger_reason = 'service_shutdown' GROUP BY ALL"""


@register("agg17_open_batches", _open_batches_sql())
def q_open_batches(spark, sf):
    """AGG-17: open (never closed) trigger batches per dataset, from PAK-02."""
    m = fx.messages(spark, sf).select("tenant_id", "dataset_id", "ts", "seq", F.octet_length("data").alias("size"))
    b = packing.pack_by_triggers(m, max_lines=50, max_bytes=4000, timeout_s=3 * 3600)
    return monitor.open_batch_stats(b, F.to_timestamp(F.lit(AS_OF)))


@register("alr03_alert_records", with_fixtures("""
SELECT event_id, coalesce(severity, 'error') AS severity, 'Error: ' || error_type AS title, message,
  'tenant=' || tenant_id || ' dataset=' || dataset_id AS details, 'tidewater' AS service, '0.1.0' AS version,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM error_reports WHERE kind = 'report'"""))
def q_alert_records(spark, sf):
    """ALR-03: error reports shaped into alert records."""
    from ..functions.text import rfc3339
    from ..operators import alerts
    r = fx.error_reports(spark, sf).where("kind = 'report'")
    a = alerts.alert_records(r, F.col("severity"), F.concat(F.lit("Error: "), F.col("error_type")), F.col("message"),
                             F.concat(F.lit("tenant="), F.col("tenant_id"), F.lit(" dataset="), F.col("dataset_id")),
                             rfc3339("ts"), keep=["event_id"])
    return a


@register("alr04_health_report", with_fixtures("""
WITH st AS (
  SELECT port, arg_max(status, (ts, event_id)) AS status FROM (
    SELECT port, ts, event_id, CASE WHEN drops > 0 AND base IS NOT NULL AND drops > base THEN 'degraded' ELSE 'healthy' END AS status
    FROM (SELECT *, last_value(CASE WHEN drops > 0 THEN drops END IGNORE NULLS) OVER (PARTITION BY port ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM port_counters)) GROUP BY port),
tp AS (SELECT port, count(*) AS messages, CAST(sum(drops) AS BIGINT) AS bytes,
         CAST(greatest((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000, 1) AS BIGINT) AS uptime_s FROM port_counters GROUP BY port),
inv AS (SELECT CAST(1000 + user_id % 6 AS INT) AS port, count(DISTINCT event_type) AS datasets FROM events GROUP BY 1)
SELECT st.port AS instance, st.status = 'healthy' AS healthy, st.status, tp.messages, tp.bytes, tp.uptime_s,
  CAST(tp.bytes AS DOUBLE) / CAST(tp.uptime_s AS DOUBLE) AS bytes_per_sec, CAST(tp.messages AS DOUBLE) / CAST(tp.uptime_s AS DOUBLE) AS messages_per_sec,
  inv.datasets
FROM st LEFT JOIN tp USING (port) LEFT JOIN inv USING (port)"""))
def q_health_report(spark, sf):
    """ALR-04: per-instance (port) health record: latest status, throughput,
    assigned datasets."""
    from ..operators import alerts
    pc = fx.port_counters(spark, sf)
    readings = pc.select(F.col("port").alias("instance"), "event_id", "ts", "drops", F.lit(0).alias("expected"),
                         F.lit(0).alias("running"))
    st = monitor.service_status(readings).join(readings.select("instance", "event_id", "ts"), ["instance", "event_id"])
    latest = st.groupBy("instance").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    tp = monitor.throughput(pc.withColumnRenamed("port", "instance"), "instance", "ts", "drops")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    inv = ev.groupBy((F.col("user_id") % 6 + 1000).cast("int").alias("instance")).agg(
        F.count_distinct("event_type").alias("datasets"))
    return alerts.health_report(latest, tp, inv, key="instance")
