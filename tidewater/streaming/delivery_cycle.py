"""The delivery cycle as a job over state tables (STM-01, 02, 07, 08).

A pass takes the files that wait (queue) or are to be tried again (retry),
hands one request row per file to the caller's sender, and turns the answers
into the next state: delivered files leave, permanent failures and exhausted
files go to the dead-letter area, the others wait for the next pass. Each pass
writes its whole state and its attempts under its own number, so a pass that
is run again replaces its own output, and a stopped cycle goes on from the
last finished pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery

OPEN = ("queue", "retry")
Sender = Callable[[DataFrame, int], DataFrame]


def start(files: DataFrame, path: str, key: str = "okey") -> None:
    """Write the state before the first pass (number 0)."""
    state = files.select(key, "id", "tenant_id", "dataset_id", "state", F.col("retry_count").cast("int").alias("retry_count"),
                         "failure_reason", "trigger_reason", F.lit(None).cast("timestamp").alias("last_retry"),
                         F.lit(0).alias("attempts_used"))
    state.write.mode("overwrite").parquet(f"{path}/state/pass=0")


def state_after(spark: SparkSession, path: str, number: int) -> DataFrame:
    """All files after a pass; delivered ones stay listed as ``delivered``."""
    return spark.read.parquet(f"{path}/state/pass={number}")


def requests(state: DataFrame, tenants: DataFrame | None, max_retries: int, key: str = "okey") -> DataFrame:
    """The files that a pass tries: of active tenants, below the limit."""
    due = state.where(F.col("state").isin(*OPEN) & ~((F.col("state") == "retry") & (F.col("retry_count") >= max_retries)))
    if tenants is not None:
        due = delivery.with_tenant_gate(due, tenants)
        due = due.where((F.col("state") == "retry") | F.col("tenant_active")).drop("tenant_active")
    return due.select(key, "id", "tenant_id", "dataset_id", (F.col("attempts_used") + 1).alias("attempt_no"))


def run_pass(spark: SparkSession, path: str, number: int, send: Sender, tenants: DataFrame | None = None, max_retries: int = 5,
             strict_permanent: bool = False, key: str = "okey") -> None:
    """Pass ``number`` (from 1). ``send(requests, number)`` returns (key,
    status_code, ts) for the files it tried; others wait."""
    before = state_after(spark, path, number - 1)
    due = requests(before, tenants, max_retries, key)
    due.write.mode("overwrite").parquet(f"{path}/requests/pass={number}")
    due = spark.read.schema(due.schema).parquet(f"{path}/requests/pass={number}")
    answers = send(due, number).select(key, "status_code", F.col("ts").cast("timestamp").alias("ts"))
    answers.write.mode("overwrite").parquet(f"{path}/attempts/pass={number}")
    answers = spark.read.schema(answers.schema).parquet(f"{path}/attempts/pass={number}")
    # Files and answers meet once: both steps are read off the joined rows.
    told = delivery.with_attempt(before, answers, key)
    told = delivery.with_tenant_gate(told, tenants) if tenants is not None else told.withColumn("tenant_active", F.lit(True))
    queued, again = delivery.queue_moves(), delivery.retry_moves(max_retries, strict_permanent, F.col("last_retry"))

    def move(name: str) -> Column:
        """What the step of the file's state says; NULL where there is none."""
        said = [F.when(F.col("state") == state, moves[name]) for state, moves in zip(OPEN, (queued, again)) if name in moves]
        return F.coalesce(*said)

    told = told.withColumns({"_state": move("new_state"), "_count": move("retry_count").cast("int"), "_why": move("failure_reason"),
                             "_trigger": move("trigger_reason"), "_at": move("last_retry")})
    # A file keeps the reason it has until a step says another.
    kept = F.col("_state").isNull() | ((F.col("_state") == F.col("state")) & F.col("_why").isNull())
    after = told.select(
        key, "id", "tenant_id", "dataset_id", F.coalesce("_state", "state").alias("state"),
        F.coalesce("_count", "retry_count").alias("retry_count"),
        F.when(kept, F.col("failure_reason")).otherwise(F.col("_why")).alias("failure_reason"),
        F.coalesce("_trigger", "trigger_reason").alias("trigger_reason"), F.coalesce("_at", "last_retry").alias("last_retry"),
        (F.col("attempts_used") + F.coalesce(F.col("attempted").cast("int"), F.lit(0))).alias("attempts_used"))
    after.write.mode("overwrite").parquet(f"{path}/state/pass={number}")


def last_pass(spark: SparkSession, path: str, most: int) -> int:
    """The last finished pass (its state is committed), -1 for none."""
    done = -1
    for number in range(most + 1):
        try:
            spark.read.parquet(f"{path}/state/pass={number}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            break
        done = number
    return done


def run_cycle(spark: SparkSession, path: str, send: Sender, tenants: DataFrame | None = None, max_retries: int = 5,
              strict_permanent: bool = False, most_passes: int = 100, key: str = "okey") -> int:
    """Run passes until nothing waits, no file was tried, or ``most_passes``;
    goes on after the last finished pass. Returns the number of the last."""
    number = last_pass(spark, path, most_passes)
    at = _progress(state_after(spark, path, number))
    while number < most_passes and at[0]:
        number += 1
        run_pass(spark, path, number, send, tenants, max_retries, strict_permanent, key)
        before, at = at, _progress(state_after(spark, path, number))
        if at == before:
            break
    return number


def _progress(state: DataFrame) -> tuple[int, int, int]:
    """Files that wait, those of them in the queue, and tries. A file goes
    from queue to retry or out, never back, and its tries only grow: a pass
    that leaves these sums as they are has left every file as it was."""
    return tuple(state.agg(F.count_if(F.col("state").isin(*OPEN)), F.count_if(F.col("state") == OPEN[0]),
                           F.coalesce(F.sum("attempts_used"), F.lit(0))).first())
