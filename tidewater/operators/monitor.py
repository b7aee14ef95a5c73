"""Monitoring: rolling error counts, drop detection, service status, CPU
ratios, error lifecycle, traffic and histogram aggregates (WIN-01..04,
WIN-07, AGG-05/06/08..12, AGG-17).

Windows are always partitioned by a key; the one rolling count that can
be global (WIN-01) is computed with two-level running sums instead of a
range window, so it never sorts a hot key into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import delivery_outcome
from ..functions.text import is_blank
from ..plans.prefix import exclusive_running_sum, last_non_null, previous_value

DAY_US = 86_400 * 1_000_000
# Default explicit histogram bucket upper bounds (inclusive).
HISTOGRAM_BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def rolling_count(events: DataFrame, partition: Sequence[str], ts: str, id_cols: Sequence[str],
                  window_us: int = DAY_US, out: str = "count_24h") -> DataFrame:
    """WIN-01: per event, the number of events in ``(t - window, t]`` of its
    partition (ties at ``t`` included, an event exactly ``window`` old
    excluded).

    Computed as ``N(<= t) - N(<= t - window)`` where both counts are
    running sums over the union of events (weight 1) and probes (weight 0,
    ordered after events at equal time), dealt by range so that a hot key
    spreads over many tasks.
    """
    part, ids = list(partition), list(id_cols)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = events.select(*part, *ids, us.alias("_t"))
    ev = base.select(*part, *ids, "_t", F.lit(1).alias("_w"), F.lit(0).alias("_kind"))
    hi = base.select(*part, *ids, "_t", F.lit(0).alias("_w"), F.lit(1).alias("_kind"))
    lo = base.select(*part, *ids, (F.col("_t") - window_us).alias("_t"), F.lit(0).alias("_w"), F.lit(2).alias("_kind"))
    u = ev.unionByName(hi).unionByName(lo)
    r = exclusive_running_sum(u, "_w", part, ["_t", "_kind", *ids], "_n")
    probes = r.where(F.col("_kind") > 0).groupBy(*part, *ids).agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_n"))).alias("_hi"),
        F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias("_lo"))
    return probes.select(*part, *ids, (F.col("_hi") - F.col("_lo")).cast("long").alias(out))


def port_drop_events(counters: DataFrame, key: str = "port", order=("ts", "event_id")) -> DataFrame:
    """WIN-02: per reading, new drops since the previous reading of the port
    (the first baseline is 0), and ``resolved`` when drops return to zero
    after being positive. The previous reading comes from a two-level lag
    so a busy port is not sorted in one task."""
    d = previous_value(counters, F.col("drops"), [key], list(order), "_last")
    last = F.coalesce(F.col("_last"), F.lit(0))
    return d.select(
        key, *[c for c in order if c != "ts"], "drops",
        F.when(F.col("drops") > last, F.col("drops") - last).otherwise(0).cast("long").alias("new_drops"),
        ((F.col("drops") == 0) & (last > 0)).alias("resolved"))


def service_status(readings: DataFrame, key: str = "instance", order=("ts", "event_id")) -> DataFrame:
    """WIN-03: unhealthy (inputs expected, none running) / degraded (total
    drops above the previous *positive* reading; the first positive reading
    only sets the baseline) / healthy. The baseline is a two-level "last
    non-null before" over positive readings."""
    d = last_non_null(readings, F.when(F.col("drops") > 0, F.col("drops")), [key], list(order),
                      "_base", include_current=False)
    base = F.col("_base")
    unhealthy = (F.col("expected") > 0) & (F.col("running") == 0)
    degraded = (F.col("drops") > 0) & base.isNotNull() & (F.col("drops") > base)
    status = F.when(unhealthy, F.lit("unhealthy")).when(degraded, F.lit("degraded")).otherwise(F.lit("healthy"))
    return d.select(key, *[c for c in order if c != "ts"], status.alias("status"))


def cpu_usage(counters: DataFrame, key: str = "host", order=("ts", "event_id")) -> DataFrame:
    """WIN-04: CPU used % and iowait % from cumulative tick counters (first
    reading of a host, or no tick change: 0). Previous counters come from a
    two-level lag."""
    ticks = ("user", "system", "idle", "iowait")
    d = previous_value(counters, F.struct(*ticks), [key], list(order), "_prev")
    delta = {c: F.col(c) - F.col(f"_prev.{c}") for c in ticks}
    total = delta["user"] + delta["system"] + delta["idle"] + delta["iowait"]
    idle = delta["idle"] + delta["iowait"]
    ok = total.isNotNull() & (total > 0)
    return d.select(
        key, *[c for c in order if c != "ts"],
        F.when(ok, (total - idle).cast("double") / total.cast("double") * 100).otherwise(0.0).alias("cpu_used_pct"),
        F.when(ok, delta["iowait"].cast("double") / total.cast("double") * 100).otherwise(0.0).alias("cpu_iowait_pct"))


def error_queue(reports: DataFrame, capacity: int = 1000, order=("ts", "event_id")) -> DataFrame:
    """WIN-07: the retry queue keeps only the newest ``capacity`` reports
    (oldest dropped first): a distributed top-k, severity defaulted."""
    r = reports.where(F.col("kind") == "report")
    top = r.orderBy(*[F.col(c).desc() for c in order]).limit(capacity)
    return top.withColumn("severity", F.coalesce("severity", F.lit("error")))


def open_errors(reports: DataFrame, keys=("error_type", "dataset_id")) -> DataFrame:
    """WIN-07: reports still open — later than the last resolve event of
    their (type, dataset); severity defaults to ``error``."""
    rep = reports.where(F.col("kind") == "report")
    res = reports.where(F.col("kind") == "resolve").groupBy(*keys).agg(F.max("ts").alias("resolved_at"))
    j = rep.join(res, list(keys), "left")
    return j.where(F.col("resolved_at").isNull() | (F.col("ts") > F.col("resolved_at"))) \
        .withColumn("severity", F.coalesce("severity", F.lit("error")))


def dataset_traffic(files: DataFrame, attempts: DataFrame, key: str = "okey") -> DataFrame:
    """AGG-05: per (tenant, dataset): delivered batches, bytes and lines
    forwarded, and failed attempts (errors)."""
    o = delivery_outcome(F.col("status_code"))
    per_file = attempts.groupBy(key).agg(F.count_if(o == "success").alias("ok"), F.count_if(o != "success").alias("errors"))
    j = files.select(key, "tenant_id", "dataset_id", "size", "line_count").join(per_file, key, "inner")
    return j.groupBy("tenant_id", "dataset_id").agg(
        F.sum("ok").cast("long").alias("batches_forwarded"),
        F.sum(F.col("size") * F.col("ok")).cast("long").alias("bytes_forwarded"),
        F.sum(F.col("line_count") * F.col("ok")).cast("long").alias("lines_forwarded"),
        F.sum("errors").cast("long").alias("errors"))


def throughput(df: DataFrame, key: str, ts: str, size: str) -> DataFrame:
    """AGG-06: counters divided by max(uptime seconds, 1)."""
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(size).cast("long").alias("bytes"),
        F.floor((F.unix_micros(F.max(F.col(ts)).cast("timestamp"))
                 - F.unix_micros(F.min(F.col(ts)).cast("timestamp"))) / 1_000_000).alias("up"))
    up = F.greatest(F.col("up"), F.lit(1)).cast("double")
    return g.select(key, "messages", "bytes", F.greatest(F.col("up"), F.lit(1)).cast("long").alias("uptime_s"),
                    (F.col("bytes").cast("double") / up).alias("bytes_per_sec"),
                    (F.col("messages").cast("double") / up).alias("messages_per_sec"))


def check_summary(results: DataFrame, key: str, status: str = "check_status") -> DataFrame:
    """AGG-08: success / failed / error counts and integer success rate."""
    s = F.col(status)
    g = results.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "success").alias("success"),
                                 F.count_if(s == "failed").alias("failed"), F.count_if(s == "error").alias("error"))
    return g.withColumn("success_rate", F.when(F.col("total") > 0, (F.col("success") * 100).cast("long") / F.col("total"))
                        .otherwise(0).cast("long"))


def retry_pass_results(step: DataFrame) -> DataFrame:
    """AGG-09: a retry pass summarised per tenant and in total (level 1).
    Files that had no attempt are not processed. Rows are reduced per tenant
    first; the rollup runs over those partials."""
    st = F.col("new_state")
    done = step.where((st != "retry") | F.col("failure_reason").isNotNull())
    per = done.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(st == "delivered").alias("succeeded"),
        F.count_if(st == "retry").alias("failed"), F.count_if(st == "dlq").alias("to_dlq"))
    return per.rollup("tenant_id").agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(c).cast("long").alias(c) for c in ("processed", "succeeded", "failed", "to_dlq")])


def input_counters(df: DataFrame, key: Sequence[str], ts: str, size: str, dropped: Column) -> DataFrame:
    """AGG-10: received, bytes, dropped and last time per input key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("received"), F.sum(size).cast("long").alias("bytes"),
                                F.count_if(dropped).alias("dropped"), F.max(ts).alias("last_time"))


def metric_counters(step: DataFrame) -> DataFrame:
    """AGG-11: request counters by (tenant, dataset, status) and the queue
    gauge as a signed sum (+1 enqueued, -1 per delivery). Files without an
    attempt are ``waiting`` and count no request."""
    st = F.col("new_state")
    status = F.when(st == "delivered", F.lit("success")).when(st == "retry", F.lit("retry")) \
        .when(st == "queue", F.lit("waiting")).otherwise(F.lit("error"))
    return step.groupBy("tenant_id", "dataset_id", status.alias("status")).agg(
        F.count_if(st != "queue").alias("requests"),
        F.sum(F.when(st == "delivered", -1).otherwise(0) + 1).cast("long").alias("queue_gauge"))


def received_counters(messages: DataFrame, data: str = "data") -> DataFrame:
    """AGG-11: packets, bytes and non-blank lines received per (tenant,
    dataset)."""
    lines = F.size(F.filter(F.split(F.col(data), "\n", -1), lambda l: ~is_blank(l)))
    return messages.groupBy("tenant_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length(data)).cast("long").alias("bytes"),
        F.sum(lines).cast("long").alias("lines"))


def forwarded_counters(files: DataFrame, step: DataFrame) -> DataFrame:
    """AGG-11: bytes and lines forwarded per (tenant, dataset), and the queue's
    byte gauge as a signed sum (+ size enqueued, - size per delivery)."""
    done = (F.col("new_state") == "delivered").cast("long")
    j = files.select("id", "size", "line_count").join(step.select("id", "tenant_id", "dataset_id", "new_state"), "id")
    return j.groupBy("tenant_id", "dataset_id").agg(
        F.sum(F.col("size") * done).cast("long").alias("bytes_forwarded"),
        F.sum(F.col("line_count") * done).cast("long").alias("lines_forwarded"),
        F.sum(F.col("size") * (1 - done)).cast("long").alias("bytes_gauge"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds=HISTOGRAM_BOUNDS) -> DataFrame:
    """AGG-12: explicit-bucket histogram (bucket i: bounds[i-1] < v <= bounds[i],
    last bucket unbounded) with count, sum, min and max per key."""
    v = F.col(value)
    idx = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        idx = F.when(v <= bounds[i], F.lit(i)).otherwise(idx)
    return df.groupBy(*keys, idx.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(v).cast("long").alias("sum"),
        F.min(v).cast("long").alias("min"), F.max(v).cast("long").alias("max"))


def open_batch_stats(batches: DataFrame, as_of: Column) -> DataFrame:
    """AGG-17: batches still open (flushed only at shutdown) per key: count,
    messages, bytes, and age of the oldest in seconds at ``as_of``."""
    o = batches.where(F.col("trigger_reason") == "service_shutdown")
    return o.groupBy("tenant_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("open_batches"), F.sum("messages").cast("long").alias("messages"),
        F.sum("bytes").cast("long").alias("bytes"),
        (F.unix_timestamp(as_of) - F.unix_timestamp(F.min("first_ts").cast("timestamp"))).cast("long").alias("age_s"))
