"""Queries over the spool tables: statistics, listings, retention, delivery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts, delivery, retention, spool
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..streaming import delivery_cycle
from .catalog import register
from .oracle_fixtures import GATE_SQL, outcome_sql, reason_sql, with_fixtures

# Parameters of the retention queries (bytes / counts at any scale factor).
MAX_TENANT_BYTES = 150_000_000
MAX_FILES_PER_DATASET = 100
DLQ_LIMIT_BYTES = 500_000_000
AS_OF = "2002-01-01 00:00:00"
MAX_AGE_DAYS = 2000
MAX_RETRIES = 5


def _listing(spark, sf):
    return spool.with_path_parts(fx.spool_listing(spark, sf))


@register("src10_spool_scan", with_fixtures("""
SELECT tenant_id, dataset_id, state, count(*) FILTER (WHERE NOT is_meta) AS data_files,
  count(*) FILTER (WHERE is_meta) AS meta_files, CAST(sum(length) AS BIGINT) AS bytes
FROM listing_p GROUP BY ALL"""))
def q_spool_scan(spark, sf):
    """SRC-10: listing paths parsed into tenant / dataset / state."""
    l = _listing(spark, sf)
    return l.groupBy("tenant_id", "dataset_id", "state").agg(
        F.count_if(~F.col("is_meta")).alias("data_files"), F.count_if("is_meta").alias("meta_files"),
        F.sum("length").cast("long").alias("bytes"))


@register("agg01_dlq_stats", with_fixtures("""
SELECT tenant_id, dataset_id, CAST(grouping(tenant_id, dataset_id) AS INT) AS level,
  count(*) FILTER (WHERE state = 'queue') AS queue_files,
  CAST(coalesce(sum(length) FILTER (WHERE state = 'queue'), 0) AS BIGINT) AS queue_bytes,
  count(*) FILTER (WHERE state = 'dlq') AS dlq_files,
  CAST(coalesce(sum(length) FILTER (WHERE state = 'dlq'), 0) AS BIGINT) AS dlq_bytes,
  arg_min(file, (modificationTime, file)) FILTER (WHERE state = 'queue') AS oldest_queue_file,
  arg_min(file, (modificationTime, file)) FILTER (WHERE state = 'dlq') AS oldest_dlq_file
FROM listing_p WHERE NOT is_meta AND state IN ('queue', 'dlq')
GROUP BY ROLLUP (tenant_id, dataset_id)"""))
def q_dlq_stats(spark, sf):
    """AGG-01: queue / DLQ statistics per dataset, tenant and total."""
    return spool.dlq_stats(_listing(spark, sf))


@register("agg02_dir_counts", with_fixtures("""
SELECT tenant_id, dataset_id, state, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes,
  arg_min(file, (modificationTime, file)) AS oldest_file
FROM listing_p WHERE NOT is_meta AND suffix(file, '.gz')
GROUP BY ALL"""))
def q_dir_counts(spark, sf):
    """AGG-02: per-directory counts of data files (``.gz``; ``.meta`` never)."""
    return spool.directory_counts(_listing(spark, sf), suffix=".gz")


@register("agg03_detailed_stats", with_fixtures("""
WITH sets AS (
  SELECT tenant_id, dataset_id, CAST(grouping(tenant_id, dataset_id) AS INT) AS level, status, count(*) AS n,
    sum(size) AS b, min(created_at) AS o, max(created_at) AS w
  FROM (SELECT * REPLACE (CASE WHEN okey % 17 = 0 THEN 'paused' ELSE status END AS status) FROM spool_files)
  GROUP BY GROUPING SETS ((tenant_id, dataset_id, status), (tenant_id, status), (status)))
SELECT tenant_id, dataset_id, level, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes,
  min(o) AS oldest, max(w) AS newest, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses
FROM sets GROUP BY tenant_id, dataset_id, level"""))
def q_detailed_stats(spark, sf):
    """AGG-03: detailed statistics; some files have a status of their own."""
    f = fx.spool_files(spark, sf).withColumn("status", F.when(F.col("okey") % 17 == 0, "paused").otherwise(F.col("status")))
    pairs = F.array_sort(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return spool.detailed_stats(f).withColumn("statuses", F.array_join(pairs, ","))


@register("agg04_tenant_lookup", with_fixtures("""
SELECT r.tenant_id, CAST(coalesce(s.files, 0) AS BIGINT) AS files, CAST(coalesce(s.bytes, 0) AS BIGINT) AS bytes
FROM (SELECT 'tenant' || n_nationkey AS tenant_id FROM nation) r
LEFT JOIN (SELECT tenant_id, count(*) AS files, sum(size) AS bytes FROM spool_files GROUP BY 1) s USING (tenant_id)"""))
def q_tenant_lookup(spark, sf):
    """AGG-04: requested tenants (one per nation) with zero defaults."""
    stats = spool.detailed_stats(fx.spool_files(spark, sf)).where("level = 1").select("tenant_id", "files", "bytes")
    req = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("tenant"), F.col("n_nationkey").cast("string")).alias("tenant_id"))
    return spool.stats_lookup(stats, req)


@register("agg13_tenant_size", with_fixtures("""
SELECT tenant_id, CAST(grouping(tenant_id) AS INT) AS level, CAST(sum(length) AS BIGINT) AS bytes
FROM listing_p WHERE NOT is_meta GROUP BY ROLLUP (tenant_id)"""))
def q_tenant_size(spark, sf):
    """AGG-13: tenant sizes (all data files) and the total."""
    return spool.tenant_sizes(_listing(spark, sf))


@register("agg14_latest_token", with_fixtures("""
SELECT tenant_id, arg_max(bearer_token, (created_at, id)) AS bearer_token FROM spool_files GROUP BY 1"""))
def q_latest_token(spark, sf):
    """AGG-14: latest bearer token per tenant."""
    return spool.latest_token(fx.spool_files(spark, sf))


@register("agg15_ineligible_per_dataset", with_fixtures("""
SELECT tenant_id, dataset_id, count(*) AS files FROM spool_files
WHERE state <> 'dlq' AND status <> 'success' GROUP BY ALL"""))
def q_ineligible(spark, sf):
    """AGG-15: non-deletable files per dataset (metadata outside the DLQ)."""
    return spool.ineligible_per_dataset(fx.spool_files(spark, sf).where("state <> 'dlq'"))


@register("srt01_list_dlq", with_fixtures("""
SELECT * EXCLUDE (n), CASE WHEN n > 100 THEN '100+' ELSE CAST(n AS VARCHAR) END AS count_label FROM (
  SELECT row_number() OVER (ORDER BY tenant_id, dataset_id, id) AS rank, tenant_id, dataset_id, id,
         split_part(path, '/', 4) AS file, size, count(*) OVER () AS n
  FROM spool_files f
  WHERE state = 'dlq' AND tenant_id = 'tenant3'
    AND EXISTS (SELECT 1 FROM spool_listing l WHERE l.path = f.path))
WHERE rank <= 100"""))
def q_list_dlq(spark, sf):
    """SRT-01 + JON-08 + VAL-08: first 100 DLQ files of one tenant."""
    return spool.list_dlq(fx.spool_files(spark, sf), _listing(spark, sf), tenant="tenant3")


@register("srt02_oldest_first", with_fixtures("""
SELECT id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS age_rank
FROM spool_files WHERE state <> 'dlq'"""))
def q_oldest_first(spark, sf):
    """SRT-02: oldest-first rank of all cleanup candidates per tenant (id
    breaks ties)."""
    f = fx.spool_files(spark, sf).where("state <> 'dlq'")
    return spool.oldest_first(f).select("id", "tenant_id", F.col("age_rank").cast("long").alias("age_rank"))


@register("jon07_pair_meta", with_fixtures("""
SELECT m.tenant_id, m.dataset_id, m.batch_id, d.path IS NOT NULL AS paired FROM
 (SELECT tenant_id, dataset_id, regexp_replace(file, '\\.meta$', '') AS batch_id FROM listing_p WHERE state = 'retry' AND is_meta) m
 LEFT JOIN (SELECT tenant_id, dataset_id, regexp_replace(file, '\\.gz$', '') AS batch_id, path FROM listing_p
            WHERE state = 'retry' AND NOT is_meta) d USING (tenant_id, dataset_id, batch_id)"""))
def q_pair_meta(spark, sf):
    """JON-07: retry metadata paired with data files; orphans flagged."""
    jobs, orphans = spool.pair_data_and_meta(_listing(spark, sf))
    k = ["tenant_id", "dataset_id", "batch_id"]
    return jobs.select(*k, F.lit(True).alias("paired")).unionByName(orphans.select(*k, F.lit(False).alias("paired")))


@register("jon08_meta_exists", with_fixtures("""
SELECT f.id FROM spool_files f WHERE f.state = 'dlq' AND EXISTS (SELECT 1 FROM spool_listing l WHERE l.path = f.path)"""))
def q_meta_exists(spark, sf):
    """JON-08: DLQ metadata whose data file still exists (left-semi join)."""
    f = fx.spool_files(spark, sf).where("state = 'dlq'")
    return f.join(fx.spool_listing(spark, sf).select("path"), "path", "left_semi").select("id")


@register("set02_delivery_jobs", with_fixtures("""
SELECT stage, file_path, meta_path FROM (
  SELECT 0 AS stage, path AS file_path, NULL AS meta_path FROM listing_p WHERE state = 'queue' AND NOT is_meta
  UNION ALL
  SELECT 1, d.path, m.path FROM listing_p m JOIN listing_p d
    ON m.tenant_id = d.tenant_id AND m.dataset_id = d.dataset_id
   AND regexp_replace(m.file, '\\.meta$', '') = regexp_replace(d.file, '\\.gz$', '')
  WHERE m.state = 'retry' AND m.is_meta AND d.state = 'retry' AND NOT d.is_meta)"""))
def q_delivery_jobs(spark, sf):
    """SET-02: queue jobs then retry jobs (UNION ALL with a stage column)."""
    return spool.delivery_jobs(_listing(spark, sf)).select("stage", "file_path", "meta_path")


@register("ret01_global_cleanup", with_fixtures("""
SELECT id FROM spool_files WHERE status = 'success'"""))
def q_global_cleanup(spark, sf):
    """RET-01: files the global policy may delete."""
    return retention.cleanup_eligible(fx.spool_files(spark, sf)).select("id")


@register("ret02_tenant_cleanup", with_fixtures(f"""
WITH cand AS (SELECT * FROM spool_files WHERE state <> 'dlq'),
tsize AS (SELECT tenant_id, sum(length) AS tenant_bytes FROM listing_p WHERE NOT is_meta GROUP BY 1),
succ AS (SELECT tenant_id, sum(size) AS sb FROM cand WHERE status = 'success' GROUP BY 1),
after1 AS (SELECT t.tenant_id, t.tenant_bytes - coalesce(s.sb, 0) AS a1 FROM tsize t LEFT JOIN succ s USING (tenant_id)),
rest AS (SELECT *,
    coalesce(sum(size) OVER (PARTITION BY tenant_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (PARTITION BY tenant_id, dataset_id ORDER BY created_at, id) AS rn,
    count(*) OVER (PARTITION BY tenant_id, dataset_id) AS n
  FROM cand WHERE status <> 'success'),
removed AS (
  SELECT id, 1 AS pass FROM cand WHERE status = 'success'
  UNION ALL SELECT r.id, 2 FROM rest r JOIN after1 a USING (tenant_id) WHERE a.a1 - r.before > {MAX_TENANT_BYTES}
  UNION ALL SELECT id, 3 FROM rest WHERE rn <= n - {MAX_FILES_PER_DATASET})
SELECT id, ['success', 'size', 'dataset_limit'][min(pass)] AS removed_by FROM removed GROUP BY id"""))
def q_tenant_cleanup(spark, sf):
    """RET-02: per-tenant cleanup (three passes, union of removals)."""
    return retention.tenant_cleanup(fx.spool_files(spark, sf), _listing(spark, sf),
                                    MAX_TENANT_BYTES, MAX_FILES_PER_DATASET)


@register("ret03_dlq_eviction", with_fixtures(f"""
SELECT path, length, modificationTime FROM (
  SELECT *, sum(length) OVER () AS total,
    coalesce(sum(length) OVER (ORDER BY modificationTime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM listing_p WHERE state = 'dlq' AND NOT is_meta)
WHERE total - before > {DLQ_LIMIT_BYTES}"""))
def q_dlq_eviction(spark, sf):
    """RET-03: global FIFO eviction of the DLQ down to the limit."""
    return retention.dlq_eviction(_listing(spark, sf), DLQ_LIMIT_BYTES)


@register("ret03_dlq_eviction_per_tenant", with_fixtures(f"""
SELECT path, length, modificationTime FROM (
  SELECT *, sum(length) OVER (PARTITION BY tenant_id) AS total,
    coalesce(sum(length) OVER (PARTITION BY tenant_id ORDER BY modificationTime, path
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM listing_p WHERE state = 'dlq' AND NOT is_meta)
WHERE total - before > {DLQ_LIMIT_BYTES // 10}"""))
def q_dlq_eviction_tenant(spark, sf):
    """RET-03 per tenant."""
    return retention.dlq_eviction(_listing(spark, sf), DLQ_LIMIT_BYTES // 10, per_tenant=True)


@register("ret04_ageing", with_fixtures(f"""
SELECT id, tenant_id, dataset_id, 'dlq' AS status,
  CASE WHEN age > {MAX_AGE_DAYS} * 86400 THEN 'older than {MAX_AGE_DAYS} days'
       ELSE 'older than 15m0s (age ' || (age // 3600) || 'h' || ((age % 3600) // 60) || 'm' || (age % 60) || 's)' END
    AS failure_reason,
  TIMESTAMP '{AS_OF}' AS last_retry
FROM (SELECT *, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(created_at) AS BIGINT) AS age FROM spool_files)
WHERE status <> 'dlq' AND age > 900"""))
def q_ageing(spark, sf):
    """RET-04: ageing to the DLQ as of a fixed instant."""
    return retention.ageing(fx.spool_files(spark, sf), AS_OF, MAX_RETRIES, 60, MAX_AGE_DAYS)


_FIRST_ATTEMPT = "(SELECT okey, status_code, ts FROM attempts WHERE attempt_no = 1)"


@register("stm02_queue_step", with_fixtures(f"""
SELECT id, okey, tenant_id, dataset_id, new_state,
  CASE WHEN new_state = 'retry' THEN 1 WHEN new_state = 'dlq' THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN NOT act THEN 'no active tenant' WHEN new_state = 'queue' OR o = 'success' THEN NULL ELSE {reason_sql('status_code')} END AS failure_reason,
  CASE WHEN new_state = 'dlq' THEN 'permanent_failure' WHEN new_state = 'retry' THEN 'upload_failed' ELSE trigger_reason END AS trigger_reason
FROM (SELECT f.*, a.status_code, {GATE_SQL} AS act, {outcome_sql('a.status_code')} AS o,
        CASE WHEN NOT {GATE_SQL} THEN 'dlq' WHEN a.okey IS NULL THEN 'queue' WHEN {outcome_sql('a.status_code')} = 'success' THEN 'delivered'
             WHEN {outcome_sql('a.status_code')} = 'permanent' THEN 'dlq' ELSE 'retry' END AS new_state
      FROM spool_files f LEFT JOIN tenants t USING (tenant_id) LEFT JOIN {_FIRST_ATTEMPT} a ON a.okey = f.okey
      WHERE f.state = 'queue')"""))
def q_queue_step(spark, sf):
    """STM-02 + VAL-07 + PRJ-07: one queue pass with first attempts."""
    a = fx.attempts(spark, sf).where("attempt_no = 1")
    return delivery.queue_step(fx.spool_files(spark, sf), a, fx.tenants(spark, sf))


@register("stm01_retry_step", with_fixtures(f"""
SELECT id, okey, tenant_id, dataset_id,
  CASE WHEN retry_count >= {MAX_RETRIES} THEN 'dlq' WHEN NOT waits AND o = 'success' THEN 'delivered' ELSE 'retry' END AS new_state,
  CASE WHEN retry_count >= {MAX_RETRIES} OR waits OR o = 'success' THEN retry_count ELSE retry_count + 1 END AS retry_count,
  CASE WHEN retry_count >= {MAX_RETRIES} THEN 'max_retries_exceeded' WHEN waits OR o = 'success' THEN NULL
       ELSE {reason_sql('status_code')} END AS failure_reason,
  CASE WHEN retry_count >= {MAX_RETRIES} OR waits OR o = 'success' THEN NULL ELSE ts END AS last_retry
FROM (SELECT f.*, a.status_code, a.ts, a.okey IS NULL AS waits, {outcome_sql('a.status_code')} AS o
      FROM spool_files f LEFT JOIN attempts a ON a.okey = f.okey AND a.attempt_no = f.retry_count + 1
      WHERE f.state = 'retry')"""))
def q_retry_step(spark, sf):
    """STM-01: one retry pass; the next attempt is number retry_count + 1."""
    f = fx.spool_files(spark, sf).where("state = 'retry'")
    a = fx.attempts(spark, sf)
    nxt = f.select("okey", (F.col("retry_count") + 1).alias("attempt_no")).join(a, ["okey", "attempt_no"], "inner")
    return delivery.retry_step(f, nxt.select("okey", "status_code", "ts"), MAX_RETRIES)


_REPLAY = with_fixtures(f"""
WITH pf AS (
  SELECT okey, count(*) AS n, arg_min({outcome_sql('status_code')}, attempt_no) AS fo,
    arg_min_null(status_code, attempt_no) AS fc,
    min(attempt_no) FILTER (WHERE {outcome_sql('status_code')} = 'success') AS fs,
    arg_max_null(status_code, attempt_no) AS lc
  FROM attempts GROUP BY okey),
j AS (SELECT f.id, f.okey, f.tenant_id, f.dataset_id, {GATE_SQL} AS act, coalesce(pf.n, 0) AS n, pf.fo, pf.fc, pf.fs, pf.lc
      FROM spool_files f LEFT JOIN tenants t USING (tenant_id) LEFT JOIN pf USING (okey) WHERE f.state = 'queue'),
s AS (SELECT *, CASE WHEN NOT act THEN 'dlq' WHEN n = 0 THEN 'queue' WHEN fo = 'success' THEN 'delivered'
      WHEN fo = 'permanent' THEN 'dlq' WHEN fs IS NOT NULL AND fs <= {MAX_RETRIES} THEN 'delivered'
      WHEN n >= {MAX_RETRIES} THEN 'dlq' ELSE 'retry' END AS final_state FROM j)
SELECT id, okey, tenant_id, dataset_id, final_state,
  CAST(CASE WHEN NOT act OR n = 0 THEN 0 WHEN fo IN ('success', 'permanent') THEN 1
       WHEN fs IS NOT NULL AND fs <= {MAX_RETRIES} THEN fs ELSE least(n, {MAX_RETRIES}) END AS INT) AS attempts_used,
  CAST(CASE WHEN NOT act OR fo = 'permanent' OR n = 0 OR fo = 'success' THEN 0
       WHEN fs IS NOT NULL AND fs <= {MAX_RETRIES} THEN fs - 1 ELSE least(n, {MAX_RETRIES}) END AS INT) AS retry_count,
  CASE WHEN NOT act THEN 'no active tenant' WHEN fo = 'permanent' THEN {reason_sql('fc')}
       WHEN final_state = 'dlq' THEN 'max_retries_exceeded' WHEN final_state = 'retry' THEN {reason_sql('lc')} END AS failure_reason
FROM s""")


@register("stm03_replay", _REPLAY)
def q_replay(spark, sf):
    """STM-03: final state of every queue file from its attempt history."""
    return delivery.replay(fx.spool_files(spark, sf), fx.attempts(spark, sf), fx.tenants(spark, sf), MAX_RETRIES)


@register("stm04_immediate_upload", with_fixtures(f"""
SELECT id, tenant_id, dataset_id,
  CASE WHEN slot > 50 THEN 'retry' WHEN o = 'success' THEN 'removed' ELSE 'retry' END AS new_state,
  CASE WHEN slot > 50 THEN 'channel_capacity_exceeded' WHEN o = 'success' THEN NULL ELSE {reason_sql('status_code')} END AS failure_reason
FROM (SELECT f.*, a.status_code, {outcome_sql('a.status_code')} AS o,
        row_number() OVER (PARTITION BY tenant_id, dataset_id ORDER BY created_at, id) AS slot
      FROM spool_files f LEFT JOIN {_FIRST_ATTEMPT} a USING (okey) WHERE f.state = 'queue')"""))
def q_immediate_upload(spark, sf):
    """STM-04: immediate upload with a per-dataset channel capacity of 50."""
    a = fx.attempts(spark, sf).where("attempt_no = 1")
    return delivery.immediate_upload(fx.spool_files(spark, sf), a, capacity=50)


@register("stm05_dlq_replay", with_fixtures("""
SELECT * FROM (SELECT id, CASE WHEN state = 'dlq' AND tenant_id = 'tenant3' THEN 'retry' ELSE state END AS state,
             CASE WHEN state = 'dlq' AND tenant_id = 'tenant3' THEN 'retry' ELSE status END AS status,
             state = 'dlq' AND tenant_id = 'tenant3' AS retried,
             CASE WHEN state = 'dlq' AND tenant_id = 'tenant3' THEN 0 ELSE retry_count END AS retry_count,
             CASE WHEN state = 'dlq' AND tenant_id = 'tenant3' THEN 'taken back from the dead-letter area' ELSE failure_reason END AS failure_reason
      FROM spool_files)"""))
def q_dlq_replay(spark, sf):
    """STM-05: replay one tenant's DLQ (dataset wildcard)."""
    r = delivery.dlq_replay(fx.spool_files(spark, sf), tenant="tenant3", dataset="*")
    return r.select("id", "state", "status", "retried", "retry_count", "failure_reason")


@register("stm06_orphans", with_fixtures("""
SELECT id, CASE WHEN state = 'queue' THEN 'retry' ELSE state END AS state,
  CASE WHEN state = 'queue' THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN state = 'queue' THEN 'service_restart' ELSE trigger_reason END AS trigger_reason
FROM spool_files"""))
def q_orphans(spark, sf):
    """STM-06: orphaned queue files recovered into retry."""
    r = delivery.recover_orphans(fx.spool_files(spark, sf))
    return r.select("id", "state", "retry_count", "trigger_reason")


@register("stm07_move_to_dlq", with_fixtures(f"""
SELECT id, 'dlq' AS state, 'dlq' AS status, 'max_retries_exceeded' AS failure_reason, TIMESTAMP '{AS_OF}' AS last_retry
FROM spool_files WHERE state = 'retry' AND retry_count >= {MAX_RETRIES}"""))
def q_move_to_dlq(spark, sf):
    """STM-07: exhausted retry files moved with their specific reason."""
    f = fx.spool_files(spark, sf).where(F.col("state") == "retry").where(F.col("retry_count") >= MAX_RETRIES)
    m = delivery.move_to_dlq(f, F.lit("max_retries_exceeded"), F.to_timestamp(F.lit(AS_OF)).cast("timestamp_ntz"))
    return m.select("id", "state", "status", "failure_reason", "last_retry")


@register("stm08_dequeue", with_fixtures(f"""
SELECT id, state FROM spool_files f
WHERE NOT EXISTS (SELECT 1 FROM {_FIRST_ATTEMPT} a WHERE a.okey = f.okey AND f.state = 'queue'
                  AND {outcome_sql('a.status_code')} = 'success')"""))
def q_dequeue(spark, sf):
    """STM-08: remove delivered queue files (left-anti join)."""
    files = fx.spool_files(spark, sf)
    step = delivery.queue_step(files, fx.attempts(spark, sf).where("attempt_no = 1"))
    delivered = step.where(F.col("new_state") == "delivered").select("id")
    return delivery.dequeue_delivered(files, delivered).select("id", "state")


@register("alr01_dlq_alerts", with_fixtures("""
WITH s AS (SELECT tenant_id, dataset_id, CAST(grouping(tenant_id, dataset_id) AS INT) AS level,
    count(*) FILTER (WHERE state = 'dlq') AS dlq_files, CAST(coalesce(sum(length) FILTER (WHERE state = 'dlq'), 0) AS BIGINT) AS dlq_bytes
  FROM listing_p WHERE NOT is_meta AND state IN ('queue', 'dlq') GROUP BY ROLLUP (tenant_id, dataset_id))
SELECT tenant_id, dataset_id, level, 'dlq_size' AS alert, 'high' AS severity, dlq_bytes AS observed, CAST(524288000 AS BIGINT) AS threshold
FROM s WHERE dlq_bytes > 524288000
UNION ALL
SELECT tenant_id, dataset_id, level, 'dlq_count', 'high', dlq_files, CAST(1000 AS BIGINT) FROM s WHERE dlq_files > 1000"""))
def q_dlq_alerts(spark, sf):
    """ALR-01: DLQ size / count alerts at every rollup level."""
    return alerts.dlq_alerts(spool.dlq_stats(_listing(spark, sf)))


@register("alr02_space_alerts", with_fixtures("""
SELECT tenant_id, used_bytes, max_bytes,
  CASE WHEN used_bytes * 100 > max_bytes * 95 THEN 'critical' ELSE 'high' END AS severity
FROM (SELECT tenant_id, CAST(sum(length) AS BIGINT) AS used_bytes, CAST(340000000 AS BIGINT) AS max_bytes
      FROM listing_p WHERE NOT is_meta GROUP BY 1)
WHERE used_bytes * 100 > max_bytes * 85"""))
def q_space_alerts(spark, sf):
    """ALR-02: per-tenant space alerts against a 340 MB quota."""
    u = spool.tenant_sizes(_listing(spark, sf)).where("level = 0").select(
        "tenant_id", F.col("bytes").alias("used_bytes"), F.lit(340_000_000).cast("long").alias("max_bytes"))
    return alerts.space_alerts(u)


@register("stm09_delivery_cycle", _REPLAY)
def q_delivery_cycle(spark, sf):
    """STM-01, 02, 07 and 08 as the delivery job runs them, pass by pass,
    against a receiver that answers as the attempts say; the end is that of
    the replay of the whole history."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cycle-{uuid.uuid4().hex}"
    # The history is numbered once and laid out by the pass that may ask for
    # it; what no pass asks for lies in the last folder.
    turn = F.least("attempt_no", F.lit(MAX_RETRIES + 1)).alias("turn")
    attempts = fx.attempts(spark, sf).select("okey", "attempt_no", "status_code", "ts", turn)
    attempts.write.partitionBy("turn").parquet(f"{path}/history")
    attempts = spark.read.schema(attempts.schema).parquet(f"{path}/history")

    def answer(due, number):
        # A file that got no answer to an attempt has none in the history.
        now = F.col("turn") == min(number, MAX_RETRIES + 1)
        return due.join(attempts.where(now), ["okey", "attempt_no"]).select("okey", "status_code", "ts")

    queue = fx.spool_files(spark, sf).where("state = 'queue'").withColumn("retry_count", F.lit(0)) \
        .withColumn("failure_reason", F.lit(None).cast("string"))
    delivery_cycle.start(queue, path)
    last = delivery_cycle.run_cycle(spark, path, answer, fx.tenants(spark, sf), MAX_RETRIES)
    return delivery_cycle.state_after(spark, path, last).select(
        "id", "okey", "tenant_id", "dataset_id", F.col("state").alias("final_state"), "attempts_used", "retry_count", "failure_reason")
