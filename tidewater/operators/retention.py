"""Retention policies over the spool tables (RET-01..04).

Ordered-prefix rules ("remove oldest until under the limit") are exclusive
running sums compared with a threshold; the running sums are computed in
two levels (``plans.prefix``) so no policy sorts a tenant — or the whole
DLQ — inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import exclusive_running_sum, running_sums
from . import spool


def cleanup_eligible(files: DataFrame) -> DataFrame:
    """RET-01: only successfully delivered files may be deleted; DLQ and
    undelivered files never."""
    return files.where((F.col("status") == "success") & (F.col("status") != "dlq"))


def tenant_cleanup(files: DataFrame, listing: DataFrame, max_tenant_bytes: int,
                   max_files_per_dataset: int = 0) -> DataFrame:
    """RET-02: per-tenant cleanup; returns removed files with the first pass
    that removes them (``success`` / ``size`` / ``dataset_limit``).

    Candidates are metadata rows outside the DLQ, oldest first (id breaks
    ties). Tenant size counts every data file of the tenant. Pass 2 removes
    oldest non-success files while the size after pass 1 minus what was
    already removed exceeds the limit. Pass 3 counts non-success files per
    dataset on the original list and removes the oldest excess. The result
    is the union of the three passes.
    """
    cand = files.where(F.col("state") != "dlq").select("id", "tenant_id", "dataset_id", "size", "created_at", "status")
    tsize = spool.data_files(listing).groupBy("tenant_id").agg(F.sum("length").cast("long").alias("tenant_bytes"))
    succ = cand.where(F.col("status") == "success").groupBy("tenant_id") \
        .agg(F.sum("size").cast("long").alias("success_bytes"))
    after1 = tsize.join(succ, "tenant_id", "left").select(
        "tenant_id", (F.col("tenant_bytes") - F.coalesce("success_bytes", F.lit(0))).alias("size_after_success"))
    rest = cand.where(F.col("status") != "success")
    ranked = exclusive_running_sum(rest, "size", ["tenant_id"], ["created_at", "id"], "removed_before")
    by_size = ranked.join(after1, "tenant_id").where(
        F.col("size_after_success") - F.col("removed_before") > F.lit(max_tenant_bytes)).select("id")
    removed = [cand.where(F.col("status") == "success").select("id", F.lit(1).alias("pass"))]
    removed.append(by_size.select("id", F.lit(2).alias("pass")))
    if max_files_per_dataset > 0:
        keys = ["tenant_id", "dataset_id"]
        r = running_sums(rest, {"newer": F.lit(1)}, keys, ["created_at", "id"], inclusive=False, descending=True)
        removed.append(r.where(F.col("newer") >= max_files_per_dataset).select("id", F.lit(3).alias("pass")))
    u = removed[0]
    for x in removed[1:]:
        u = u.unionByName(x)
    first = u.groupBy("id").agg(F.min("pass").alias("pass"))
    return first.select("id", F.element_at(F.array(*[F.lit(s) for s in ("success", "size", "dataset_limit")]),
                                           F.col("pass")).alias("removed_by"))


def dlq_eviction(listing: DataFrame, limit_bytes: int, per_tenant: bool = False) -> DataFrame:
    """RET-03: FIFO eviction of DLQ data files by modification time.

    A file is evicted iff ``total - bytes_before_it > limit`` (path breaks
    ties); ``limit <= 0`` disables eviction. The running sum is dealt
    by range of the modification time. Returns the evicted files.
    """
    d = spool.data_files(listing).where(F.col("state") == "dlq").select("path", "tenant_id", "length", "modificationTime")
    if limit_bytes <= 0:
        return d.limit(0)
    part = ["tenant_id"] if per_tenant else []
    totals = d.groupBy(*part).agg(F.sum("length").cast("long").alias("total"))
    ranked = exclusive_running_sum(d, "length", part, ["modificationTime", "path"], "before")
    j = _attach_total(ranked, totals, part)
    return j.where(F.col("total") - F.col("before") > F.lit(limit_bytes)).select("path", "length", "modificationTime")


def _attach_total(df: DataFrame, totals: DataFrame, part) -> DataFrame:
    if part:
        return df.join(totals, part, "inner")
    # One global total: attach it as a constant key join (a one-row table).
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(totals.withColumn("_k", F.lit(1))), "_k").drop("_k")


def go_duration(seconds: Column) -> Column:
    """Render whole seconds like Go's ``time.Duration.String`` (``72h3m0s``)."""
    s = seconds.cast("long")
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(s == 0, F.lit("0s"))
        .when(h > 0, F.format_string("%dh%dm%ds", h, m, sec))
        .when(m > 0, F.format_string("%dm%ds", m, sec))
        .otherwise(F.format_string("%ds", sec))
    )


def ageing(files: DataFrame, as_of: str, retry_attempts: int = 5, retry_interval_s: int = 60,
           max_age_days: int = 0) -> DataFrame:
    """RET-04: files (outside the DLQ) moved to the DLQ by age.

    Age above ``attempts x interval x 3`` moves a file; above
    ``max_age_days`` (when > 0) the reason is overridden. ``as_of`` replaces
    the wall clock. Returns moved files with the new status and reason.
    """
    now = F.to_timestamp(F.lit(as_of))
    f = files.where(F.col("status") != "dlq")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    max_age = retry_attempts * retry_interval_s * 3
    r1 = F.when(age > max_age, F.format_string("older than %s (age %s)",
                                               go_duration(F.lit(max_age)), go_duration(age)))
    reason = r1
    if max_age_days > 0:
        reason = F.when(age > max_age_days * 86400,
                        F.lit(f"older than {max_age_days} days")).otherwise(r1)
    return f.withColumn("failure_reason", reason).where(F.col("failure_reason").isNotNull()).select(
        "id", "tenant_id", "dataset_id", F.lit("dlq").alias("status"), "failure_reason",
        now.cast("timestamp_ntz").alias("last_retry"))
