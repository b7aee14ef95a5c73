"""Queries over the streaming jobs.

STR-05 and STR-07 are the batch twins of the event-time operators (the tests
hold the streams against them). STR-02, STR-03 and STR-06 run the jobs
themselves: the messages or files arrive in three parts, one run a part over
one checkpoint, and the result must be that of the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spool
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..streaming import batching, jobs
from .catalog import register
from .oracle_fixtures import with_fixtures
from .packing_queries import MAX_BYTES, MAX_LINES, PAK02_SQL, TIMEOUT_S


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _arrivals(df: DataFrame, day) -> list[DataFrame]:
    """The rows in three parts by day of the month, in order of time."""
    return [df.where(day < 11), df.where((day >= 11) & (day < 21)), df.where((day >= 21) | day.isNull())]


def _sized(spark, sf):
    return fx.messages(spark, sf).select("tenant_id", "dataset_id", "ts", "seq", F.octet_length("data").alias("size"))


@register("str05_idle_gap_batches", with_fixtures("""
SELECT tenant_id, dataset_id, min(ts) AS batch_start, max(ts) + INTERVAL 3 HOUR AS batch_end, count(*) AS messages,
  CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 3 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY tenant_id, dataset_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM (SELECT tenant_id, dataset_id, ts, seq, strlen(data) AS size,
              lag(ts) OVER (PARTITION BY tenant_id, dataset_id ORDER BY ts, seq) AS prev FROM messages))
GROUP BY tenant_id, dataset_id, sid"""))
def q_idle_gap_batches(spark, sf):
    """STR-05: idle-gap (session window) batches per dataset."""
    b = jobs.idle_gap_batches(_sized(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), gap="3 hours")
    return b.select("tenant_id", "dataset_id", F.col("batch_start").cast("timestamp_ntz").alias("batch_start"),
                    F.col("batch_end").cast("timestamp_ntz").alias("batch_end"), "messages", "bytes")


@register("str07_rolling_traffic", with_fixtures("""
SELECT date_trunc('minute', ts) AS window_start, tenant_id, dataset_id, count(*) AS messages,
  CAST(sum(strlen(data)) AS BIGINT) AS bytes
FROM messages GROUP BY ALL"""))
def q_rolling_traffic(spark, sf):
    """STR-07: per-minute traffic per dataset."""
    r = jobs.rolling_traffic(_sized(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tenant_id", "dataset_id",
                    "messages", "bytes")


@register("str02_trigger_stream", PAK02_SQL)
def q_trigger_stream(spark, sf):
    """STR-02: trigger batches of a message stream in three runs, the open
    batches flushed at the end; the same as packing all messages at once."""
    m = _sized(spark, sf)
    source, state, sink, checkpoint = (_folder(spark) for _ in range(4))
    stream = None
    for part in _arrivals(m, F.dayofmonth("ts")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(m.schema).parquet(source)
        batching.trigger_batch_job(stream, state, sink, checkpoint, MAX_LINES, MAX_BYTES, TIMEOUT_S).awaitTermination()
    per = batching.batches_with_open(spark, state, sink, 2, m.schema)
    return per.select("tenant_id", "dataset_id", "batch_no", "messages", "bytes",
                      F.timestamp_micros("first_us").cast("timestamp_ntz").alias("first_ts"),
                      F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_ts"), "trigger_reason")


@register("str03_sticky_stream", with_fixtures("""
SELECT tenant_id, dataset_id, count(*) AS lines, count(*) FILTER (WHERE wrapped) AS wrapped_lines FROM landed
GROUP BY tenant_id, dataset_id"""))
def q_sticky_stream(spark, sf):
    """STR-03: the format that the first line of a key decides holds in later
    runs, whose first lines would decide otherwise for some keys."""
    m = fx.messages(spark, sf)
    last = m.agg(F.max("seq")).first()[0] or 0
    source, sink, checkpoint = (_folder(spark) for _ in range(3))
    for part in _arrivals(m, F.col("seq") * 31 / (last + 1)):
        part.write.mode("append").parquet(source)
        jobs.ingest_stream_batches(spark, source, m.schema, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).groupBy("tenant_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("wrapped"), 1)).alias("wrapped_lines"))


@register("str06_periodic_counts", with_fixtures("""
SELECT tenant_id, dataset_id, state, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes,
  arg_min(file, (modificationTime, file)) AS oldest_file
FROM listing_p WHERE NOT is_meta GROUP BY ALL"""))
def q_periodic_counts(spark, sf):
    """STR-06: a periodic job keeps directory counts up to date: each run
    counts the files that came since the last one into its own partition, and
    the counts of all runs add up."""
    files = spool.with_path_parts(fx.spool_listing(spark, sf))
    source, sink, checkpoint = (_folder(spark) for _ in range(3))

    def count(df: DataFrame, batch_id: int) -> None:
        per = df.where(~F.col("is_meta")).groupBy("tenant_id", "dataset_id", "state").agg(
            F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
            F.min(F.struct("modificationTime", "file")).alias("oldest"))
        per.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(sink)

    for part in _arrivals(files, F.dayofmonth("modificationTime")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(files.schema).parquet(source)
        jobs.run_periodic(spark, stream, count, checkpoint, every=None).awaitTermination()
    return spark.read.parquet(sink).groupBy("tenant_id", "dataset_id", "state").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.min("oldest").alias("_o")) \
        .select("tenant_id", "dataset_id", "state", "files", "bytes", F.col("_o.file").alias("oldest_file"))
