"""Structured Streaming twins of the batch operators (STR-01..07).

* STR-01 ingest: ``readStream`` -> framing -> sticky detection (STR-03) ->
  envelope / stamp -> partitioned Parquet sink with a checkpoint
  (exactly-once file sink).
* STR-02 trigger batching: ``transformWithStateInPandas`` with a value
  state per (tenant, dataset) and a processing-time timer for the idle
  timeout; an explicit close pass flushes what is open at shutdown.
* STR-03 sticky format: value state per (input, tenant, dataset).
* STR-04 retry state per file over an attempts stream.
* STR-05 idle-gap batches: ``session_window`` + watermark.
* STR-06 periodic jobs: ``foreachBatch`` under a processing-time or
  ``availableNow`` trigger.
* STR-07 rolling traffic metrics: tumbling ``window`` + watermark.

State stores use RocksDB; checkpoints go under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as TX
from ..functions.naming import PERMANENT_CODES
from ..operators import framing
from ..operators.split_fold import TriggerRule
from ..session import checkpoint_dir, prepare

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_streaming(spark: SparkSession) -> str:
    """Session settings for the stateful jobs; returns the checkpoint root."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return checkpoint_dir(spark)


# --- STR-03: sticky format detection ------------------------------------------


def _strict_json(line: str) -> bool:
    """Whole-line JSON validity (any JSON value; NaN / Infinity rejected)."""
    if line is None or not line.strip():
        return False

    def bad(_: str):
        raise ValueError("non-finite")

    try:
        json.loads(line, parse_constant=bad)
        return True
    except (ValueError, RecursionError):
        return False


class StickyFormatProcessor(StatefulProcessor):
    """Per (input, tenant, dataset): the first auto-mode line decides, once,
    whether the key's lines are JSON; the decision is kept in state.
    Emits the rows with ``detected_json`` added (payload passes through)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fmt = handle.getValueState("fmt", "is_json boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.fmt.exists():
            # Known key: stream chunk by chunk, nothing is buffered.
            decided = bool(self.fmt.get()[0])
            for pdf in rows:
                yield pdf.assign(detected_json=decided)
            return
        # New key: its first line may be in any chunk of this micro-batch.
        pdf = pd.concat(list(rows), ignore_index=True)
        first = pdf.sort_values(["seq", "line_no"], kind="stable").iloc[0]
        decided = _strict_json(first["line"])
        self.fmt.update((decided,))
        yield pdf.assign(detected_json=decided)

    def close(self) -> None:
        pass


def sticky_detect_stream(lines: DataFrame, keys=("input", "tenant_id", "dataset_id")) -> DataFrame:
    """STR-03 + FMT-03/05: stateful detection, then envelope in the JVM."""
    schema = T.StructType(lines.schema.fields + [T.StructField("detected_json", T.BooleanType())])
    auto = lines.where(framing.is_auto_mode(F.col("data_format")))
    explicit = lines.where(~framing.is_auto_mode(F.col("data_format"))).withColumn(
        "detected_json", F.lit(None).cast("boolean"))
    det = auto.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=StickyFormatProcessor(), outputStructType=schema, outputMode="Append", timeMode="None")
    both = det.unionByName(explicit)
    m = F.coalesce(F.col("data_format"), F.lit(""))
    wrapped = F.when(m == "ndjson", F.lit(False)).when(m == "text", F.lit(True)).otherwise(~F.col("detected_json"))
    return (both.withColumn("wrapped", wrapped)
            .withColumn("out", F.when(F.col("wrapped"), TX.wrap_text("line", "ts")).otherwise(F.col("line")))
            .drop("detected_json"))


def ingest_stream(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                  available_now: bool = True, max_files_per_trigger: int = 1000):
    """STR-01: continuous landing of messages into a partitioned raw table
    (exactly-once file sink; sticky detection in operator state)."""
    prepare_streaming(spark)
    msgs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    lines = sticky_detect_stream(framing.split_lines(msgs))
    out = framing.stamp(lines, line="out", hint="data_hint", ts="ts")
    w = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("tenant_id", "dataset_id").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def land_micro_batch(batch: DataFrame, batch_id: int, state_path: str, sink: str,
                     keys=("input", "tenant_id", "dataset_id")) -> None:
    """STR-01/03 as a ``foreachBatch`` step with the detection memo kept as a
    table (all JVM, no per-key buffering).

    Decisions of earlier batches are read from ``state_path``; keys first
    seen in this batch are decided by the batch operator and appended. Both
    writes replace only this batch's partition (``batch_id``), so a retried
    batch rewrites its own output instead of duplicating it.
    """
    spark = batch.sparkSession
    lines = framing.split_lines(batch)
    k = list(keys)
    fields = T.StructType([*[batch.schema[c] for c in k], T.StructField("detected_json", T.BooleanType()),
                           T.StructField("batch_id", T.LongType())])
    try:
        prior = spark.read.schema(fields).parquet(state_path).where(F.col("batch_id") < batch_id).select(*k, "detected_json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        prior = None  # no state written yet
    fresh = framing.first_line_detection(lines, k)
    if prior is not None:
        known = prior.select(*[F.col(c).alias(f"_k_{c}") for c in k])
        on = F.lit(True)
        for c in k:
            on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        fresh = fresh.join(known, on, "left_anti")
    replace = {"partitionOverwriteMode": "dynamic"}
    fresh.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").options(**replace) \
        .partitionBy("batch_id").parquet(state_path)
    det = spark.read.schema(fields).parquet(state_path).where(F.col("batch_id") <= batch_id).select(*k, "detected_json")
    j = framing.with_detection(lines, det, k)
    m = F.coalesce(F.col("data_format"), F.lit(""))
    wrapped = F.when(m == "ndjson", F.lit(False)).when(m == "text", F.lit(True)).otherwise(~F.col("detected_json"))
    out = (j.withColumn("wrapped", wrapped)
           .withColumn("out", F.when(F.col("wrapped"), TX.wrap_text("line", "ts")).otherwise(F.col("line")))
           .drop("detected_json"))
    out = framing.stamp(out, line="out", hint="data_hint", ts="ts").withColumn("batch_id", F.lit(batch_id))
    out.write.mode("overwrite").options(**replace).partitionBy("batch_id", "tenant_id", "dataset_id").parquet(sink)


def ingest_stream_batches(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                          available_now: bool = True, max_files_per_trigger: int = 1000):
    """STR-01 with ``land_micro_batch``: the detection memo lives in a table
    under the checkpoint, so hot keys never gather in one Python worker."""
    prepare_streaming(spark)
    state = checkpoint.rstrip("/") + "/detections"
    msgs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    w = msgs.writeStream.foreachBatch(lambda df, bid: land_micro_batch(df, bid, state, sink)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# --- STR-02: trigger batching -----------------------------------------------------

BATCH_EVENT_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("batch_no", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("trigger_reason", T.StringType()),
])


REASONS = {1: "line_limit_reached", 2: "size_limit_reached"}


class TriggerBatchProcessor(StatefulProcessor):
    """STR-02: per (tenant, dataset) open batch (number, count, bytes).

    Each message is assigned to the open batch; after adding, the count or
    byte trigger closes it. Every input refreshes an idle timer; when it
    fires, the open batch closes with ``timeout``. Rows: assignments (seq
    set, trigger NULL) and close events (seq NULL, trigger set). A key's rows
    of one micro-batch are sorted in one worker; ``batching`` has the form
    that spreads them."""

    def __init__(self, max_lines: int = 0, max_bytes: int = 0, timeout_ms: int = 0):
        self.rule, self.timeout_ms = TriggerRule(max_lines, max_bytes, 0), timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batch = handle.getValueState("batch", "batch_no long, cnt long, byt long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        bn, cnt, byt, timer = self.batch.get() if self.batch.exists() else (0, 0, 0, 0)
        size = pdf["size"].to_numpy("int64")
        nothing = np.zeros(len(pdf), "int64")
        (cnt, byt, _, bn), (number, close) = self.rule.step((cnt, byt, 0, bn), nothing, size, nothing + 1)
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if cnt > 0 and self.timeout_ms > 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(timer)
        self.batch.update((bn, cnt, byt, timer))
        assigned = pd.DataFrame({"batch_no": number, "seq": pdf["seq"], "size": size, "trigger_reason": None})
        closed = pd.DataFrame({"batch_no": number[close > 0], "seq": None, "size": None,
                               "trigger_reason": [REASONS[c] for c in close[close > 0]]})
        for events in (assigned, closed):
            if len(events):
                yield events.assign(tenant_id=key[0], dataset_id=key[1])[[f.name for f in BATCH_EVENT_SCHEMA.fields]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.batch.exists():
            bn, cnt, byt, _ = self.batch.get()
            if cnt > 0:
                self.batch.update((bn + 1, 0, 0, 0))
                yield pd.DataFrame([(key[0], key[1], bn, None, None, "timeout")],
                                   columns=[f.name for f in BATCH_EVENT_SCHEMA.fields])

    def close(self) -> None:
        pass


def trigger_batches_stream(messages: DataFrame, max_lines: int = 0, max_bytes: int = 0, timeout_s: int = 0) -> DataFrame:
    """STR-02 over a message stream with ``size`` (bytes) per message.

    The idle timeout uses processing-time timers, which fire on a
    continuous (``processingTime``) trigger; an ``availableNow`` run stops
    before wall-clock timers can fire, so finish such runs with
    ``close_open_batches`` (the shutdown flush)."""
    return messages.select("tenant_id", "dataset_id", "seq", "ts", F.col("size").cast("long")) \
        .groupBy("tenant_id", "dataset_id").transformWithStateInPandas(
            statefulProcessor=TriggerBatchProcessor(max_lines, max_bytes, timeout_s * 1000),
            outputStructType=BATCH_EVENT_SCHEMA, outputMode="Append",
            # Timers only when an idle timeout is configured.
            timeMode="ProcessingTime" if timeout_s > 0 else "None")


def close_open_batches(events: DataFrame) -> DataFrame:
    """Shutdown flush: batches with assignments but no close event close
    with ``service_shutdown``; returns one row per batch with its trigger."""
    keys = ["tenant_id", "dataset_id", "batch_no"]
    g = events.groupBy(*keys).agg(
        F.count("seq").alias("messages"), F.sum("size").cast("long").alias("bytes"),
        F.max("trigger_reason").alias("trigger_reason"))
    return g.where(F.col("messages") > 0).withColumn(
        "trigger_reason", F.coalesce("trigger_reason", F.lit("service_shutdown")))


# --- STR-04: retry state per file ---------------------------------------------------

RETRY_STATE_SCHEMA = T.StructType([
    T.StructField("okey", T.LongType()), T.StructField("state", T.StringType()),
    T.StructField("attempts_used", T.IntegerType()), T.StructField("retry_count", T.IntegerType()),
    T.StructField("last_code", T.IntegerType()),
])


# Buckets of files; a checkpoint keeps the number that it was begun with.
RETRY_BUCKETS = 1024
STATES = ("queue", "retry", "delivered", "dlq")
QUEUE, RETRY, DELIVERED, DLQ = range(4)
# The files of a bucket as columns: key, whether it is NULL, state, attempts
# used, retry count, last code and whether there is none.
_KEPT = (("key", "<i8"), ("null", "?"), ("state", "<i1"), ("used", "<i4"), ("cnt", "<i4"), ("code", "<i4"), ("none", "?"))
_NO_ATTEMPT = (1 << 63) - 1


def retry_states(kept: dict, key, null, code, none, max_retries: int) -> tuple[dict, np.ndarray]:
    """Advance ``kept`` by attempts whose rows of a file are neighbours and in
    order; returns the new columns, in order of (NULL, key), and where the
    files that had attempts are. All files take a step at once; a file is done
    after ``max_retries`` steps at most, however many attempts it has."""
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
    end = np.concatenate((first[1:], [len(key)]))
    new = {c: np.zeros(len(first), t) for c, t in _KEPT} | {"key": key[first], "null": null[first], "none": np.ones(len(first), bool)}
    both = {c: np.concatenate((kept[c], new[c])) for c, _ in _KEPT}
    order = np.lexsort((both["key"], both["null"]))  # stable: what is kept comes before a new row of its file
    again = np.zeros(len(order), bool)
    again[1:] = (both["key"][order][1:] == both["key"][order][:-1]) & (both["null"][order][1:] == both["null"][order][:-1])
    s = {c: v[order][~again] for c, v in both.items()}
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(~again) - 1
    touched = place[len(kept["key"]):]
    at, live = first.copy(), np.arange(len(first))
    while len(live):
        live = live[(at[live] < end[live]) & (s["state"][touched[live]] < DELIVERED)]
        row, f = at[live], touched[live]
        c, no = code[row], none[row]
        good = ~no & (c >= 200) & (c < 300)
        hard = ~no & ~good & (np.isin(c, PERMANENT_CODES) | ((c >= 400) & (c < 500) & (c != 429)))
        queued = s["state"][f] == QUEUE
        s["used"][f] += 1
        s["code"][f], s["none"][f] = np.where(no, 0, c), no
        s["cnt"][f] = np.where(queued, np.where(good | hard, 0, 1), s["cnt"][f] + ~good)
        state = np.where(good, DELIVERED, np.where(queued & hard, DLQ, RETRY))
        s["state"][f] = np.where((state == RETRY) & (s["cnt"][f] >= max_retries), DLQ, state)
        at[live] += 1
    return s, touched


class RetryStateProcessor(StatefulProcessor):
    """STR-04: the queue / retry / DLQ state of the files of one bucket, each
    advanced by its attempts in order (queue step first, then retry steps; a
    file reaching the retry limit moves to the DLQ; attempts after a final
    state are ignored). Emits the state of each file that had attempts in the
    micro-batch. A bucket's states are read and written as columns, once."""

    def __init__(self, max_retries: int = 5):
        self.max_retries = max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.st = handle.getValueState("files", ", ".join(f"`{c}` binary" for c, _ in _KEPT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["no_key", "okey", "attempt_no"], kind="stable")
        held = self.st.get() if self.st.exists() else [b""] * len(_KEPT)
        kept = {c: np.frombuffer(bytes(v), t) for (c, t), v in zip(_KEPT, held)}
        s, touched = retry_states(kept, *[pdf[c].to_numpy() for c in ("okey", "no_key", "status_code", "no_code")], self.max_retries)
        self.st.update(tuple(s[c].astype(t).tobytes() for c, t in _KEPT))
        t = {c: v[touched] for c, v in s.items()}
        yield pd.DataFrame({
            "okey": pd.arrays.IntegerArray(t["key"].astype("int64"), t["null"].copy()),
            "state": np.array(STATES, object)[t["state"]], "attempts_used": t["used"], "retry_count": t["cnt"],
            "last_code": pd.arrays.IntegerArray(t["code"].astype("int32"), t["none"].copy())})

    def close(self) -> None:
        pass


def retry_state_stream(attempts: DataFrame, max_retries: int = 5, buckets: int = RETRY_BUCKETS) -> DataFrame:
    """STR-04 over an attempts stream keyed by file. The files are dealt into
    ``buckets`` by a hash of the key: a worker holds the states and the
    micro-batch's attempts of one bucket."""
    zero = F.lit(0)
    d = attempts.select(
        F.pmod(F.xxhash64("okey"), F.lit(buckets)).alias("bucket"),
        F.coalesce(F.col("okey").cast("long"), zero.cast("long")).alias("okey"), F.col("okey").isNull().alias("no_key"),
        F.coalesce(F.col("attempt_no").cast("long"), F.lit(_NO_ATTEMPT)).alias("attempt_no"),
        F.coalesce(F.col("status_code").cast("int"), zero).alias("status_code"), F.col("status_code").isNull().alias("no_code"))
    return d.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RetryStateProcessor(max_retries), outputStructType=RETRY_STATE_SCHEMA,
        outputMode="Append", timeMode="None")


# --- STR-05 / STR-07: event-time windows -------------------------------------------------


def idle_gap_batches(df: DataFrame, gap: str = "3 hours", keys=("tenant_id", "dataset_id"), ts: str = "ts",
                     size: str = "size", watermark: str | None = None) -> DataFrame:
    """STR-05: batches closed by an idle gap alone (session windows).

    A new batch starts when the gap since the key's last message is at
    least ``gap``. ``watermark`` bounds state in a stream (the late-data
    rule is ours; the original has none)."""
    d = df.withWatermark(ts, watermark) if watermark else df
    w = F.session_window(F.col(ts), gap)
    return d.groupBy(*keys, w.alias("w")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(size).cast("long").alias("bytes")).select(
        *keys, F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "messages", "bytes")


def rolling_traffic(df: DataFrame, every: str = "1 minute", keys=("tenant_id", "dataset_id"), ts: str = "ts",
                    size: str = "size", watermark: str | None = None) -> DataFrame:
    """STR-07: per-minute traffic per dataset (tumbling windows)."""
    d = df.withWatermark(ts, watermark) if watermark else df
    return d.groupBy(F.window(F.col(ts), every).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(size).cast("long").alias("bytes")).select(
        F.col("w.start").alias("window_start"), *keys, "messages", "bytes")


# --- STR-06: periodic jobs --------------------------------------------------------------


def run_periodic(spark: SparkSession, source: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str,
                 every: str | None = "30 seconds"):
    """STR-06: run ``job(batch_df, batch_id)`` for each trigger of a source
    stream (``every=None`` processes what is available and stops). The job
    must be idempotent per ``batch_id`` (overwrite its partition)."""
    w = source.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()
