"""Retention, delivery state machine, monitoring windows, alerts."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import alerts, configs, delivery, monitor, retention, spool


def _listing(spark, rows):
    df = spark.createDataFrame(rows, "path string, length long, modificationTime timestamp")
    return spool.with_path_parts(df.withColumn("modificationTime", F.col("modificationTime").cast("timestamp_ntz")))


T0 = dt.datetime(2024, 1, 1)


def test_dlq_eviction_boundaries(spark):
    rows = [("t/d/dlq/a.gz", 10, T0), ("t/d/dlq/b.gz", 10, T0), ("t/d/dlq/c.gz", 10, T0 + dt.timedelta(days=2)),
            ("t/d/dlq/c.meta", 99, T0), ("t/d/queue/q.gz", 99, T0)]
    l = _listing(spark, rows)
    assert retention.dlq_eviction(l, 30).count() == 0  # total == limit: nothing
    assert retention.dlq_eviction(l, 0).count() == 0  # disabled
    ev = [r.path for r in retention.dlq_eviction(l, 15).collect()]
    assert sorted(ev) == ["t/d/dlq/a.gz", "t/d/dlq/b.gz"]  # equal mtimes: path order, FIFO


def test_listing_parser_layouts(spark):
    df = spark.createDataFrame([("2024/01/02/t1/d1/queue/f.gz",), ("data/t1/d1/dlq/f.gz",), ("raw/t9--d9--1--raw.gz",)], "path string")
    r1 = df.select(spool.parse_spool_path(F.col("path"), "date_tenant").alias("p")).first().p
    r2 = df.select(spool.parse_spool_path(F.col("path"), "protocol_tenant").alias("p")).collect()[1].p
    r3 = df.select(spool.parse_spool_path(F.col("path"), "flat").alias("p")).collect()[2].p
    assert (r1.tenant_id, r1.dataset_id, r1.state) == ("t1", "d1", "queue")
    assert (r2.tenant_id, r2.state) == ("t1", "dlq")
    assert (r3.tenant_id, r3.dataset_id, r3.state) == ("t9", "d9", "raw")


def _files(spark, rows):
    return spark.createDataFrame(rows, "id string, okey long, tenant_id string, dataset_id string, state string, "
                                       "status string, retry_count int, trigger_reason string, failure_reason string, "
                                       "last_retry timestamp")


def test_retry_step_rules(spark):
    f = _files(spark, [("a", 1, "t", "d", "retry", "retry", 5, "x", "", None),
                       ("b", 2, "t", "d", "retry", "retry", 1, "x", "", None),
                       ("c", 3, "t", "d", "retry", "retry", 2, "x", "", None),
                       ("e", 4, "t", "d", "retry", "retry", 0, "x", "", None)])
    a = spark.createDataFrame([(1, 200, T0), (2, 404, T0), (3, 429, T0), (4, 200, T0)],
                              "okey long, status_code int, ts timestamp")
    got = {r.id: (r.new_state, r.retry_count, r.failure_reason) for r in delivery.retry_step(f, a, 5).collect()}
    assert got["a"] == ("dlq", 5, "max_retries_exceeded")  # at the limit: no attempt
    assert got["b"][:2] == ("retry", 2)  # permanent on a retry file only counts
    assert got["c"][:2] == ("retry", 3)  # 429 is transient
    assert got["e"][:2] == ("delivered", 0)
    strict = {r.id: r.new_state for r in delivery.retry_step(f, a, 5, strict_permanent=True).collect()}
    assert strict["b"] == "dlq"


def test_queue_step_tenant_gate(spark):
    f = _files(spark, [("a", 1, "t1", "d", "queue", "pending", 0, "timeout", "", None),
                       ("b", 2, "t2", "d", "queue", "pending", 0, "timeout", "", None),
                       ("c", 3, "t3", "d", "queue", "pending", 0, "timeout", "", None)])
    a = spark.createDataFrame([(1, 500, T0), (2, 500, T0), (3, 401, T0)], "okey long, status_code int, ts timestamp")
    tenants = spark.createDataFrame([("t1", 200, False), ("t2", 500, None)], "tenant_id string, status_code int, active boolean")
    got = {r.id: (r.new_state, r.retry_count, r.trigger_reason) for r in delivery.queue_step(f, a, tenants).collect()}
    assert got["a"] == ("dlq", 0, "permanent_failure")  # inactive tenant
    assert got["b"] == ("retry", 1, "upload_failed")  # lookup failure fails open
    assert got["c"] == ("dlq", 0, "permanent_failure")  # 401 permanent on a queue file


def test_replay_off_by_one(spark):
    f = _files(spark, [("a", 1, "t", "d", "queue", "pending", 0, "x", "", None)])
    codes = [503, 503, 503, 503, 503, 200]
    a = spark.createDataFrame([(1, i + 1, c, T0) for i, c in enumerate(codes)],
                              "okey long, attempt_no int, status_code int, ts timestamp")
    r = delivery.replay(f, a, max_retries=5).first()
    assert (r.final_state, r.attempts_used, r.retry_count) == ("dlq", 5, 5)
    a2 = spark.createDataFrame([(1, 1, 503, T0), (1, 2, 503, T0)], "okey long, attempt_no int, status_code int, ts timestamp")
    r2 = delivery.replay(f, a2, max_retries=5).first()
    assert (r2.final_state, r2.retry_count) == ("retry", 2)


def test_rolling_count_excludes_exactly_24h(spark):
    rows = [("i", 1, T0), ("i", 2, T0 + dt.timedelta(hours=24)), ("i", 3, T0 + dt.timedelta(hours=24)),
            ("i", 4, T0 + dt.timedelta(hours=47))]
    df = spark.createDataFrame(rows, "instance string, id long, ts timestamp")
    got = {r.id: r.count_24h for r in monitor.rolling_count(df, ["instance"], "ts", ["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3}


def test_auth_backoff(spark):
    codes = [401, 403, 500, 404, 401, 401, 200, 401]
    df = spark.createDataFrame([("i", T0 + dt.timedelta(minutes=k), k, c) for k, c in enumerate(codes)],
                               "instance string, ts timestamp, event_id long, status int")
    rows = configs.auth_backoff(df).orderBy("event_id").collect()
    assert [r.failures for r in rows] == [1, 2, 2, 3, 4, 5, 0, 1]
    assert [r.backoff_min for r in rows] == [1, 2, 2, 4, 8, 16, 0, 1]
    assert [r.circuit_open for r in rows] == [False] * 5 + [True, False, False]


def test_space_alerts(spark):
    df = spark.createDataFrame([("a", 96, 100), ("b", 86, 100), ("c", 85, 100)], "k string, used_bytes long, max_bytes long")
    assert {r.k: r.severity for r in alerts.space_alerts(df).collect()} == {"a": "critical", "b": "high"}


def test_service_status_baseline(spark):
    rows = [(1, 0, 5), (2, 0, 5), (3, 0, 7), (4, 0, 0), (5, 0, 7), (6, 0, 8), (7, 1, 8)]
    df = spark.createDataFrame([("i", T0 + dt.timedelta(minutes=k), k, 2, 2 if u == 0 else 0, d) for k, u, d in rows],
                               "instance string, ts timestamp, event_id long, expected int, running int, drops long")
    st = [r.status for r in monitor.service_status(df).orderBy("event_id").collect()]
    assert st == ["healthy", "healthy", "degraded", "healthy", "healthy", "degraded", "unhealthy"]
