"""STR-02 as a table-backed job: trigger batching of a message stream.

Each micro-batch is folded by the same split fold as the batch operator, so a
key with most of a micro-batch spreads over tasks and nothing is gathered per
key. The open batch of every key is a row of the state table; it enters the
next micro-batch as one row that stands for its messages. Both tables are
written per ``batch_id``: a retried micro-batch replaces its own output.

An open batch closes by its limits, by the idle gap before the key's next
message, by ``close_idle`` (no message since a given time), or by the
shutdown flush that ``batches_with_open`` adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.packing import batches_of
from ..operators.split_fold import TriggerRule
from .jobs import prepare_streaming

KEYS = ("tenant_id", "dataset_id")
BATCH = "batch_no long, messages long, bytes long, first_us long, last_us long"


def _schema(message: T.StructType, keys: Sequence[str], rest: str) -> T.StructType:
    fields = [T.StructField(k, message[k].dataType) for k in keys]
    return T.StructType(fields + T.StructType.fromDDL(rest).fields)


def _state_schema(message: T.StructType, keys: Sequence[str]) -> T.StructType:
    """``messages`` is 0 where no batch is open: the next one is ``batch_no``."""
    return _schema(message, keys, BATCH)


def open_batches(spark: SparkSession, state_path: str, batch_id: int, message: T.StructType, keys: Sequence[str] = KEYS) -> DataFrame:
    """The state after micro-batch ``batch_id``; empty before the first."""
    schema = _state_schema(message, keys)
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state_path}/batch_id={batch_id}")


def _safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(r, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def batch_micro_batch(batch: DataFrame, batch_id: int, state_path: str, sink: str, max_lines: int = 0, max_bytes: int = 0,
                      timeout_s: int = 0, keys: Sequence[str] = KEYS) -> None:
    """Fold one micro-batch of messages (keys, ts, seq, size) onto the state
    of the one before; write the batches it closes and the new state."""
    spark, keys = batch.sparkSession, list(keys)
    prior = open_batches(spark, state_path, batch_id - 1, batch.schema, keys)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = batch.select(*keys, F.lit(1).alias("phase"), us.alias("ts_us"), F.col("seq").cast("long").alias("seq"),
                        us.alias("first_us"), F.col("size").cast("long").alias("len"), F.lit(1).cast("long").alias("lines"))
    carried = prior.where("messages > 0").select(
        *keys, F.lit(0).alias("phase"), F.col("last_us").alias("ts_us"), F.lit(0).cast("long").alias("seq"), "first_us",
        F.col("bytes").alias("len"), F.col("messages").alias("lines"))
    rule = TriggerRule(max_lines, max_bytes, int(timeout_s) * 1_000_000)
    per = batches_of(rows.unionByName(carried), keys, ["phase", "ts_us", "seq"], rule)
    base = prior.select(*keys, F.col("batch_no").alias("_base"))
    per = _safe(per, base, keys, "left").withColumn("batch_no", F.col("batch_no") + F.coalesce("_base", F.lit(0))).drop("_base")
    replace = {"partitionOverwriteMode": "dynamic"}
    mark = F.lit(batch_id).cast("long").alias("batch_id")
    told = f"{sink}/told"
    per.select("*", mark).write.mode("overwrite").options(**replace).partitionBy("batch_id").parquet(told)
    per = spark.read.schema(per.schema).parquet(f"{told}/batch_id={batch_id}")
    last = per.groupBy(*keys).agg(F.max_by(F.struct("batch_no", "messages", "bytes", "first_us", "last_us", "trigger_reason"),
                                           "batch_no").alias("b"))
    closed = F.col("b.trigger_reason").isNotNull()
    zero = F.lit(0).cast("long")
    after = last.select(*keys, F.when(closed, F.col("b.batch_no") + 1).otherwise(F.col("b.batch_no")).alias("batch_no"),
                        *[F.when(closed, zero).otherwise(F.col(f"b.{c}")).alias(c) for c in ("messages", "bytes", "first_us", "last_us")])
    idle = _safe(prior, after.select(*keys), keys, "left_anti")
    after.unionByName(idle).select("*", mark).write.mode("overwrite").options(**replace).partitionBy("batch_id").parquet(state_path)


def closed_batches(spark: SparkSession, sink: str, message: T.StructType, keys: Sequence[str] = KEYS) -> DataFrame:
    """All batches that the job has closed so far."""
    schema = _schema(message, keys, BATCH + ", trigger_reason string")
    return spark.read.schema(schema).parquet(f"{sink}/told").where("trigger_reason IS NOT NULL").select(*schema.names)


def close_idle(state: DataFrame, now_us: int, timeout_s: int) -> DataFrame:
    """The open batches without a message for longer than the timeout, as
    closed by it (the timer of a key that stays silent)."""
    idle = (F.col("messages") > 0) & (F.lit(now_us) - F.col("last_us") > int(timeout_s) * 1_000_000)
    return state.where(idle).withColumn("trigger_reason", F.lit("timeout"))


def batches_with_open(spark: SparkSession, state_path: str, sink: str, last_batch_id: int, message: T.StructType,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """The closed batches, and what is open flushed as at a shutdown."""
    left = open_batches(spark, state_path, last_batch_id, message, keys).where("messages > 0")
    return closed_batches(spark, sink, message, keys).unionByName(
        left.withColumn("trigger_reason", F.lit("service_shutdown")))


def trigger_batch_job(messages: DataFrame, state_path: str, sink: str, checkpoint: str, max_lines: int = 0, max_bytes: int = 0,
                      timeout_s: int = 0, keys: Sequence[str] = KEYS, every: str | None = None):
    """Run ``batch_micro_batch`` on a message stream (``every=None``: what is
    there, then stop)."""
    prepare_streaming(messages.sparkSession)

    def step(df: DataFrame, batch_id: int) -> None:
        batch_micro_batch(df, batch_id, state_path, sink, max_lines, max_bytes, timeout_s, keys)

    w = messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
