"""Delivery state machine over spool files and delivery attempts (STM-*).

``files``: one row per batch file (id, tenant_id, dataset_id, state,
status, retry_count, trigger_reason, failure_reason, …).
``attempts``: one row per upload attempt (file key, attempt_no,
status_code NULL = network error, ts).

Each step is a join plus a ``when`` ladder producing the next state, so a
whole pass over millions of files is one shuffle (files ⋈ attempts on the
file key) and no per-file driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import delivery_outcome

# Failure texts and reasons recorded on state transitions.
EMPTY_BODY = "no response body"
NETWORK_ERROR = "no response: network error"
DLQ_REPLAY_REASON = "taken back from the dead-letter area"
INACTIVE_REASON = "no active tenant"


def failure_reason(status_code: Column) -> Column:
    """Failure text of an attempt: receiver reason for HTTP, else network."""
    return F.when(status_code.isNull(), F.lit(NETWORK_ERROR)).otherwise(
        F.format_string("receiver answered %d: %s", status_code, F.lit(EMPTY_BODY)))


def active_tenants(tenants: DataFrame) -> DataFrame:
    """VAL-07: tenant gate. 404/410 or ``active = false`` is inactive; any
    other lookup failure fails open (active)."""
    inactive = F.col("status_code").isin(404, 410) | ((F.col("status_code") == 200) & (F.col("active") == F.lit(False)))
    return tenants.select("tenant_id", (~inactive).alias("tenant_active"))


def with_tenant_gate(files: DataFrame, tenants: DataFrame) -> DataFrame:
    """Attach ``tenant_active`` (missing tenants fail open)."""
    return files.join(active_tenants(tenants), "tenant_id", "left") \
        .withColumn("tenant_active", F.coalesce("tenant_active", F.lit(True)))


def with_attempt(files: DataFrame, attempt: DataFrame, key: str = "okey") -> DataFrame:
    """Files with their attempt of a pass: status_code, attempt_ts, and
    ``attempted`` (NULL for a file without one)."""
    a = attempt.select(key, "status_code", F.col("ts").alias("attempt_ts"), F.lit(True).alias("attempted"))
    return files.join(a, key, "left")


def queue_moves() -> dict[str, Column]:
    """What the queue step makes of a queue file ``with_attempt`` and
    ``with_tenant_gate``."""
    o = delivery_outcome(F.col("status_code"))
    inactive = ~F.col("tenant_active")
    waits = F.col("attempted").isNull()
    new_state = (
        F.when(inactive, F.lit("dlq")).when(waits, F.lit("queue")).when(o == "success", F.lit("delivered"))
        .when(o == "permanent", F.lit("dlq")).otherwise(F.lit("retry"))
    )
    return {
        "new_state": new_state,
        "retry_count": F.when(new_state == "retry", F.lit(1)).when(new_state == "dlq", F.lit(0)).otherwise(F.col("retry_count")),
        "failure_reason": F.when(inactive, F.lit(INACTIVE_REASON)).when(waits | (o == "success"), F.lit(None).cast("string"))
        .otherwise(failure_reason(F.col("status_code"))),
        "trigger_reason": F.when(new_state == "dlq", F.lit("permanent_failure")).when(new_state == "retry", F.lit("upload_failed"))
        .otherwise(F.col("trigger_reason")),
    }


def queue_step(files: DataFrame, attempt: DataFrame, tenants: DataFrame | None = None,
               key: str = "okey") -> DataFrame:
    """STM-02: one pass over queue files with their next attempt outcome.

    Inactive tenant -> dlq (no attempt); 2xx -> delivered; permanent -> dlq
    with retry_count 0 and trigger ``permanent_failure``; transient or
    network -> retry with retry_count 1 and trigger ``upload_failed``. A file
    without an attempt in this pass stays as it is.
    """
    q = files.where(F.col("state") == "queue")
    if tenants is not None:
        q = with_tenant_gate(q, tenants)
    else:
        q = q.withColumn("tenant_active", F.lit(True))
    return with_attempt(q, attempt, key).select("id", key, "tenant_id", "dataset_id",
                                                *[c.alias(n) for n, c in queue_moves().items()])


def retry_moves(max_retries: int = 5, strict_permanent: bool = False, last_retry: Column | None = None) -> dict[str, Column]:
    """What the retry step makes of a retry file ``with_attempt``."""
    waits = F.col("attempted").isNull()
    o = F.when(~waits, delivery_outcome(F.col("status_code")))
    exhausted = F.col("retry_count") >= max_retries
    new_state = F.when(exhausted, F.lit("dlq")).when(o == "success", F.lit("delivered"))
    if strict_permanent:
        new_state = new_state.when(o == "permanent", F.lit("dlq"))
    return {
        "new_state": new_state.otherwise(F.lit("retry")),
        "retry_count": F.when(exhausted | waits | (o == "success"), F.col("retry_count")).otherwise(F.col("retry_count") + 1),
        "failure_reason": F.when(exhausted, F.lit("max_retries_exceeded")).when(waits | (o == "success"), F.lit(None).cast("string"))
        .otherwise(failure_reason(F.col("status_code"))),
        "last_retry": F.when(exhausted | waits | (o == "success"), F.lit(None) if last_retry is None else last_retry)
        .otherwise(F.col("attempt_ts")),
    }


def retry_step(files: DataFrame, attempt: DataFrame, max_retries: int = 5, key: str = "okey",
               strict_permanent: bool = False) -> DataFrame:
    """STM-01: one pass over retry files.

    retry_count >= max -> dlq ``max_retries_exceeded`` (no attempt);
    success -> delivered; any failure -> retry_count + 1 and last_retry =
    attempt time. A permanent failure does not move a retry file to the DLQ
    unless ``strict_permanent``. A file without an attempt in this pass stays
    as it is.
    """
    j = with_attempt(files.where(F.col("state") == "retry"), attempt, key)
    moves = retry_moves(max_retries, strict_permanent, F.col("last_retry") if "last_retry" in files.columns else None)
    return j.select("id", key, "tenant_id", "dataset_id", *[c.alias(n) for n, c in moves.items()])


def replay(files: DataFrame, attempts: DataFrame, tenants: DataFrame | None = None, max_retries: int = 5,
           key: str = "okey", start_count: Column | None = None) -> DataFrame:
    """STM-03: final state of each queue file from its whole attempt history.

    Pass 1 is the queue step with attempt 1; each later pass consumes the
    next attempt while ``retry_count < max``; a file that reaches the
    maximum goes to the DLQ on the *following* pass. Files whose attempts
    run out stay in retry. Closed form per file from one aggregate over its
    attempts (no per-pass loop): first success, first outcome, attempt count.
    """
    o = delivery_outcome(F.col("status_code"))
    # Fixed-width aggregation buffers only (outcome as a small int), so the
    # per-file aggregate is a partial/final hash aggregate, not a sort.
    oc = F.when(o == "success", 0).when(o == "permanent", 1).otherwise(2)
    per_file = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.min_by(oc, F.col("attempt_no")).alias("first_oc"),
        F.min_by(F.col("status_code"), F.col("attempt_no")).alias("first_code"),
        F.min(F.when(o == "success", F.col("attempt_no"))).alias("first_success_no"),
        F.max_by(F.col("status_code"), F.col("attempt_no")).alias("last_code"),
    ).withColumn("first_outcome", F.element_at(F.array(F.lit("success"), F.lit("permanent"), F.lit("transient")),
                                               F.col("first_oc") + 1)).drop("first_oc")
    q = files.where(F.col("state") == "queue")
    q = with_tenant_gate(q, tenants) if tenants is not None else q.withColumn("tenant_active", F.lit(True))
    j = q.join(per_file, key, "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
    n = F.col("n_attempts")
    fs = F.col("first_success_no")
    inactive = ~F.col("tenant_active")
    state = (
        F.when(inactive, F.lit("dlq"))
        .when(n == 0, F.lit("queue"))
        .when(F.col("first_outcome") == "success", F.lit("delivered"))
        .when(F.col("first_outcome") == "permanent", F.lit("dlq"))
        .when(fs.isNotNull() & (fs <= max_retries), F.lit("delivered"))
        .when(n >= max_retries, F.lit("dlq"))
        .otherwise(F.lit("retry"))
    )
    used = (
        F.when(inactive, F.lit(0)).when(n == 0, F.lit(0))
        .when(F.col("first_outcome").isin("success", "permanent"), F.lit(1))
        .when(fs.isNotNull() & (fs <= max_retries), fs)
        .otherwise(F.least(n, F.lit(max_retries)))
    )
    count = (
        F.when(inactive | (F.col("first_outcome") == "permanent"), F.lit(0))
        .when(n == 0, F.lit(0))
        .when(F.col("first_outcome") == "success", F.lit(0))
        .when(fs.isNotNull() & (fs <= max_retries), fs - 1)
        .otherwise(F.least(n, F.lit(max_retries)))
    )
    reason = (
        F.when(inactive, F.lit(INACTIVE_REASON))
        .when(F.col("first_outcome") == "permanent", failure_reason(F.col("first_code")))
        .when(state == "dlq", F.lit("max_retries_exceeded"))
        .when(state == "retry", failure_reason(F.col("last_code")))
    )
    return j.select("id", key, "tenant_id", "dataset_id", state.alias("final_state"),
                    used.cast("int").alias("attempts_used"), count.cast("int").alias("retry_count"),
                    reason.alias("failure_reason"))


def immediate_upload(files: DataFrame, attempt: DataFrame, capacity: int | None = None,
                     key: str = "okey") -> DataFrame:
    """STM-04: immediate upload of fresh batches: success -> removed, any
    failure -> retry; beyond ``capacity`` in-flight batches per dataset
    (oldest first) -> retry with ``channel_capacity_exceeded``."""
    from ..plans.prefix import exclusive_running_sum
    f = files.where(F.col("state") == "queue")
    a = attempt.select(key, "status_code")
    j = f.join(a, key, "left")
    o = delivery_outcome(F.col("status_code"))
    full = F.lit(False)
    if capacity is not None:
        # slot = batches before this one in its dataset (two-level count)
        j = exclusive_running_sum(j.withColumn("_one", F.lit(1)), "_one", ["tenant_id", "dataset_id"],
                                  ["created_at", "id"], "_before")
        full = F.col("_before") >= capacity
    state = F.when(full, F.lit("retry")).when(o == "success", F.lit("removed")).otherwise(F.lit("retry"))
    reason = F.when(full, F.lit("channel_capacity_exceeded")).when(o == "success", F.lit(None).cast("string")) \
        .otherwise(failure_reason(F.col("status_code")))
    return j.select("id", "tenant_id", "dataset_id", state.alias("new_state"), reason.alias("failure_reason"))


def dlq_replay(files: DataFrame, tenant: str = "*", dataset: str = "*") -> DataFrame:
    """STM-05: move matching DLQ files back to retry (count 0, fixed reason);
    ``*`` or empty matches all. Returns every file with its new state and a
    ``retried`` flag (the per-file detail rows)."""
    m = F.col("state") == "dlq"
    if tenant not in ("", "*"):
        m = m & (F.col("tenant_id") == tenant)
    if dataset not in ("", "*"):
        m = m & (F.col("dataset_id") == dataset)
    return files.select(
        "id", "tenant_id", "dataset_id", m.alias("retried"),
        F.when(m, F.lit("retry")).otherwise(F.col("state")).alias("state"),
        F.when(m, F.lit("retry")).otherwise(F.col("status")).alias("status"),
        F.when(m, F.lit(0)).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(m, F.lit(DLQ_REPLAY_REASON)).otherwise(F.col("failure_reason")).alias("failure_reason"),
    )


def recover_orphans(files: DataFrame) -> DataFrame:
    """STM-06: every queue file found at start-up goes to retry with count 0
    and trigger ``service_restart``."""
    q = F.col("state") == "queue"
    return files.select(
        "id", "tenant_id", "dataset_id",
        F.when(q, F.lit("retry")).otherwise(F.col("state")).alias("state"),
        F.when(q, F.lit(0)).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(q, F.lit("service_restart")).otherwise(F.col("trigger_reason")).alias("trigger_reason"),
    )


def move_to_dlq(files: DataFrame, reason: Column, at: Column) -> DataFrame:
    """STM-07: status dlq with the *specific* reason and last_retry time."""
    return files.withColumn("state", F.lit("dlq")).withColumn("status", F.lit("dlq")) \
        .withColumn("failure_reason", reason).withColumn("last_retry", at)


def dequeue_delivered(files: DataFrame, delivered: DataFrame, key: str = "id") -> DataFrame:
    """STM-08: drop delivered files (left-anti join on the file id)."""
    return files.join(delivered.select(key), key, "left_anti")
