"""Streaming twins against their batch operators (availableNow runs)."""

import os

import pytest

from pyspark.sql import functions as F

from tidewater.operators import delivery, framing, packing
from tidewater.sources import fixtures as fx
from tidewater.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    """Stateful test queries run with two state partitions (fast startup)."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _run(df, name, tmp):
    q = (df.writeStream.format("parquet").option("path", os.path.join(tmp, name))
         .option("checkpointLocation", os.path.join(tmp, name + "_ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    if not q.awaitTermination(300):
        q.stop()
    return q


def _stage(spark, df, tmp, name, mode="error"):
    """Write ``df`` (its partitioning kept) as the file source of a stream."""
    p = os.path.join(tmp, name + "_src")
    df.write.mode(mode).parquet(p)
    return spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", 1).parquet(p)


def test_sticky_detection_stream_equals_batch(spark, tmpdir_path):
    """Two runs over one checkpoint: the second run's lines follow the
    decisions kept in state from the first."""
    jobs.prepare_streaming(spark)
    msgs = fx.messages(spark, SF)
    cut = msgs.approxQuantile("seq", [0.5], 0.0)[0]
    stream = _stage(spark, msgs.where(F.col("seq") < cut).coalesce(1), tmpdir_path, "m")
    _run(jobs.sticky_detect_stream(framing.split_lines(stream)), "det", tmpdir_path)
    _stage(spark, msgs.where(F.col("seq") >= cut).coalesce(1), tmpdir_path, "m", mode="append")
    _run(jobs.sticky_detect_stream(framing.split_lines(stream)), "det", tmpdir_path)
    got = {(r.seq, r.line_no): r.wrapped for r in spark.read.parquet(os.path.join(tmpdir_path, "det")).collect()}
    exp = {(r.seq, r.line_no): r.wrapped for r in framing.detect_and_wrap(framing.split_lines(msgs)).collect()}
    assert got == exp


def test_retry_state_stream_equals_replay(spark, tmpdir_path):
    jobs.prepare_streaming(spark)
    files = fx.spool_files(spark, SF).where("state = 'queue'")
    att = fx.attempts(spark, SF).join(files.select("okey"), "okey", "left_semi")
    stream = _stage(spark, att.orderBy("okey", "attempt_no").coalesce(1), tmpdir_path, "a")
    _run(jobs.retry_state_stream(stream, 5), "rs", tmpdir_path)
    st = spark.read.parquet(os.path.join(tmpdir_path, "rs"))
    last = st.groupBy("okey").agg(F.max_by("state", "attempts_used").alias("state"))
    got = {r.okey: r.state for r in last.collect()}
    exp = {r.okey: r.final_state for r in delivery.replay(files, att, None, 5).where("final_state <> 'queue'").collect()}
    assert got == exp


def test_trigger_batching_stream(spark, tmpdir_path):
    jobs.prepare_streaming(spark)
    m = fx.messages(spark, SF).select("tenant_id", "dataset_id", "seq", "ts", F.octet_length("data").alias("size"))
    stream = _stage(spark, m.coalesce(1), tmpdir_path, "tb")
    _run(jobs.trigger_batches_stream(stream, max_lines=20, max_bytes=0, timeout_s=0), "tbo", tmpdir_path)
    ev = spark.read.parquet(os.path.join(tmpdir_path, "tbo"))
    batches = jobs.close_open_batches(ev)
    b = packing.pack_by_triggers(m, max_lines=20)
    assert batches.where("trigger_reason = 'line_limit_reached'").count() == \
        b.where("trigger_reason = 'line_limit_reached'").count()
    assert ev.where("seq IS NOT NULL").count() == m.count()


def test_window_twins(spark, tmpdir_path):
    m = fx.messages(spark, SF).select("tenant_id", "dataset_id", F.col("ts").cast("timestamp").alias("ts"),
                                      F.octet_length("data").alias("size"))
    stream = _stage(spark, m.coalesce(1), tmpdir_path, "w")
    _run(jobs.rolling_traffic(stream, watermark="10 minutes"), "rt", tmpdir_path)
    got = spark.read.parquet(os.path.join(tmpdir_path, "rt"))
    # Append mode emits a window once the watermark passes its end.
    horizon = m.agg(F.max("ts")).first()[0]
    import datetime as dt
    batch = jobs.rolling_traffic(m).where(F.col("window_start") + F.expr("INTERVAL 1 MINUTE")
                                          <= F.lit(horizon - dt.timedelta(minutes=10)))
    key = ["window_start", "tenant_id", "dataset_id", "messages", "bytes"]
    assert sorted(tuple(r) for r in got.select(*key).collect()) == sorted(tuple(r) for r in batch.select(*key).collect())


def test_trigger_batching_idle_timer(spark, tmpdir_path):
    """With an idle timeout the open batch of every key closes by timer
    (processing time, continuous trigger) where the batch twin flushes it."""
    import time
    jobs.prepare_streaming(spark)
    m = fx.messages(spark, SF).select("tenant_id", "dataset_id", "seq", "ts", F.octet_length("data").alias("size"))
    stream = _stage(spark, m.coalesce(1), tmpdir_path, "tt")
    out = os.path.join(tmpdir_path, "tto")
    q = (jobs.trigger_batches_stream(stream, max_lines=20, timeout_s=2).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", out + "_ckpt").outputMode("append")
         .trigger(processingTime="2 seconds").start())
    deadline = time.time() + 120
    b = packing.pack_by_triggers(m, max_lines=20)
    want = b.where("trigger_reason = 'service_shutdown'").count()
    got = 0
    while time.time() < deadline and got < want:
        time.sleep(3)
        try:
            got = spark.read.parquet(out).where("trigger_reason = 'timeout'").count()
        except Exception:  # noqa: BLE001 - nothing written yet
            got = 0
    q.stop()
    ev = spark.read.parquet(out)
    assert got == want
    assert ev.where("trigger_reason = 'line_limit_reached'").count() == \
        b.where("trigger_reason = 'line_limit_reached'").count()
