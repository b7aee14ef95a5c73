"""The landing plan: messages -> framed, detected, wrapped, stamped lines.

``messages -> FMT-01 split -> FMT-03/06 detect -> FMT-05 wrap -> FMT-14
stamp`` is one Spark plan: one aggregate over whole messages for the sticky
detection, joined to the lines by key, and projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import framing, packing
from ..sinks import batch_table
from ..sinks.spool import delivery_manifest


def land_lines(messages: DataFrame) -> DataFrame:
    """Messages to landed lines with ``wrapped``, ``out`` and ``stamped``."""
    lines = framing.split_lines(messages, "data")
    lines = framing.detect_and_wrap(lines, detection=framing.message_detection(messages))
    return framing.stamp(lines, line="out", hint="data_hint", ts="ts")


def dataset_line_summary(lines: DataFrame) -> DataFrame:
    """Per (tenant, dataset): lines, wrapped lines, stamped lines, bytes in."""
    return lines.groupBy("tenant_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("wrapped")).alias("wrapped_lines"),
        F.count_if(F.col("stamped") != F.col("out")).alias("stamped_lines"),
        F.sum(F.octet_length("line")).cast("long").alias("bytes_in"),
    )


def packed_lines(landed: DataFrame, max_batch_bytes: int = packing.DEFAULT_MAX_BATCH_BYTES) -> DataFrame:
    """Landed lines with the ``batch_no`` that PAK-01 gives their message: a
    message's lines are one raw file, and files are packed in order of time
    per (tenant, dataset, hint). Only sizes go through the packing."""
    keys = ["tenant_id", "dataset_id", "data_hint"]
    lines = landed.select(*keys, "ts", "seq", "line_no", F.coalesce("stamped", "out").alias("line"))
    raw = lines.groupBy(*keys, "ts", "seq").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("size"))
    # Every line ends in a newline already, which ``size`` counts.
    packed = packing.pack_by_size(raw.withColumn("ends_nl", F.lit(True)), keys, ("ts", "seq"), max_batch_bytes=max_batch_bytes)
    on = F.col("l.seq") == F.col("p.seq")
    for c in [*keys, "ts"]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}"))
    nanos = F.unix_micros(F.col("l.ts").cast("timestamp")) * 1000 + F.col("l.seq") % 1000
    return lines.alias("l").join(packed.alias("p"), on).select("l.*", "p.batch_no", nanos.alias("nanos"))


def ship(messages: DataFrame, path: str, base_url: str, token: str = "",
         max_batch_bytes: int = packing.DEFAULT_MAX_BATCH_BYTES) -> DataFrame:
    """Messages to upload requests: land, pack, compress into the batch table
    at ``path``, and one manifest row (SNK-05) per stored batch, with its
    ``batch_no``, counts and sizes."""
    lines = packed_lines(land_lines(messages), max_batch_bytes)
    batch_table.write_batch_table(batch_table.compress_batches(lines, order=("ts", "seq", "line_no")), path)
    stored = messages.sparkSession.read.parquet(path).drop("data")
    files = stored.select("*", F.col("total_bytes").alias("size"), F.lit("").alias("bearer_token"), F.col("filename").alias("path"),
                          F.timestamp_micros(F.expr("first_nanos div 1000")).alias("created_at"))
    return delivery_manifest(files, base_url, token).join(
        stored.select("id", "data_hint", "batch_no", "line_count", "total_bytes", "compressed_bytes"), "id")
