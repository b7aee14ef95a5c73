"""Record adapters: turn transport-shaped records into the message schema.

The sockets and client libraries of each transport are out of scope; data
arrives as tables or streams (Kafka source, file sources, Python data
sources). Each adapter is a projection, so it composes with any source.

Message schema (SRC-01)::

    seq LONG, tenant_id STRING, dataset_id STRING, input STRING,
    data STRING, data_hint STRING, metadata MAP<STRING,STRING>,
    ts TIMESTAMP_NTZ, source_ip STRING, data_format STRING

``data_format`` is the input's mode (``ndjson``, ``text`` or auto), which each
adapter hands on with every message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

MESSAGE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("data_hint", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("data_format", T.StringType()),
])


# Kafka partitions that ``seq`` tells apart.
MOST_PARTITIONS = 1 << 14


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-01: read a message table with the fixed schema (no inference)."""
    return spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def _map_from(pairs: list[tuple[str, Column]]) -> Column:
    """Map of the given entries, dropping NULL / empty values."""
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def kafka_to_messages(records: DataFrame, tenant: str, dataset: str, hint: str = "raw",
                      bearer_token: str = "", data_format: str = "") -> DataFrame:
    """SRC-02: Kafka records (key, value, topic, partition, offset,
    timestamp, headers) -> messages. Metadata: topic / partition / offset /
    plugin, ``key`` when non-empty, ``bearer_token`` when configured and
    ``header_<k>`` per header. Same shape as ``readStream.format('kafka')``
    after casting key / value to string. ``seq`` is unique and keeps each
    partition's order: the offset, then the partition."""
    base = _map_from([("topic", F.col("topic")), ("partition", F.col("partition").cast("string")),
                      ("offset", F.col("offset").cast("string")), ("plugin", F.lit("kafka")),
                      ("key", F.col("key").cast("string")), ("bearer_token", F.lit(bearer_token))])
    hdr = F.map_from_entries(F.transform(F.coalesce("headers", F.array()), lambda h: F.struct(
        F.concat(F.lit("header_"), h["key"].cast("string")).alias("k"), h["value"].cast("string").alias("v"))))
    return records.select(
        (F.col("offset").cast("long") * MOST_PARTITIONS + F.col("partition")).alias("seq"), F.lit(tenant).alias("tenant_id"), F.lit(dataset).alias("dataset_id"),
        F.lit("kafka").alias("input"), F.col("value").cast("string").alias("data"), F.lit(hint or "raw").alias("data_hint"),
        F.map_concat(base, hdr).alias("metadata"), F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("source_ip"),
        F.lit(data_format).alias("data_format"))


def nats_to_messages(records: DataFrame, tenant: str, dataset: str, hint: str = "raw",
                     queue_group: str = "", bearer_token: str = "", data_format: str = "") -> DataFrame:
    """SRC-03: NATS records (subject, reply, data, headers map<string,
    array<string>>) -> messages; first value of each header."""
    base = _map_from([("subject", F.col("subject")), ("plugin", F.lit("nats")), ("reply", F.col("reply")),
                      ("queue_group", F.lit(queue_group)), ("bearer_token", F.lit(bearer_token))])
    h = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.size(v) > 0)
    hdr = F.transform_values(F.transform_keys(h, lambda k, v: F.concat(F.lit("header_"), k)), lambda k, v: v[0])
    return records.select(
        "seq", F.lit(tenant).alias("tenant_id"), F.lit(dataset).alias("dataset_id"), F.lit("nats").alias("input"),
        F.col("data"), F.lit(hint or "raw").alias("data_hint"), F.map_concat(base, hdr).alias("metadata"),
        F.col("ts"), F.lit(None).cast("string").alias("source_ip"),
        F.lit(data_format).alias("data_format"))


def sqs_to_messages(records: DataFrame, tenant: str, dataset: str, hint: str = "raw", data_format: str = "") -> DataFrame:
    """SRC-04: SQS messages -> messages; a NULL body is dropped (and never
    acknowledged). The delete list is the set of ``message_id`` written."""
    return records.where(F.col("body").isNotNull()).select(
        "seq", F.lit(tenant).alias("tenant_id"), F.lit(dataset).alias("dataset_id"), F.lit("sqs").alias("input"),
        F.col("body").alias("data"), F.lit(hint or "raw").alias("data_hint"),
        F.create_map(F.lit("message_id"), F.col("message_id"), F.lit("plugin"), F.lit("sqs")).alias("metadata"),
        F.col("ts"), F.lit(None).cast("string").alias("source_ip"),
        F.lit(data_format).alias("data_format"))


def kinesis_to_messages(records: DataFrame, tenant: str, dataset: str, hint: str = "raw", data_format: str = "") -> DataFrame:
    """SRC-05: Kinesis records (shard_id, sequence_number, data) -> messages."""
    return records.select(
        F.col("sequence_number").cast("long").alias("seq"), F.lit(tenant).alias("tenant_id"),
        F.lit(dataset).alias("dataset_id"), F.lit("kinesis").alias("input"), F.col("data"),
        F.lit(hint or "raw").alias("data_hint"),
        F.create_map(F.lit("shard_id"), F.col("shard_id"), F.lit("plugin"), F.lit("kinesis")).alias("metadata"),
        F.col("ts"), F.lit(None).cast("string").alias("source_ip"),
        F.lit(data_format).alias("data_format"))


def http_to_messages(requests: DataFrame, tenant: str, dataset: str, hint: str = "raw",
                     bearer_token: str = "", data_format: str = "") -> DataFrame:
    """SRC-06: accepted HTTP requests -> messages. Metadata: content_type,
    user_agent, method, path, plugin; ``header_<x-…>`` (lower-cased) for
    every header whose name starts with ``X-``. Header names compare in any
    case; ``body`` may be bytes."""
    hdr = F.transform_keys("headers", lambda k, v: F.lower(k))
    base = F.create_map(
        F.lit("content_type"), F.coalesce(F.element_at(hdr, F.lit("content-type")), F.lit("")),
        F.lit("user_agent"), F.coalesce(F.element_at(hdr, F.lit("user-agent")), F.lit("")),
        F.lit("method"), F.col("method"), F.lit("path"), F.col("path"), F.lit("plugin"), F.lit("http"))
    if bearer_token:
        base = F.map_concat(base, F.create_map(F.lit("bearer_token"), F.lit(bearer_token)))
    x = F.transform_keys(F.map_filter(hdr, lambda k, v: k.startswith("x-")), lambda k, v: F.concat(F.lit("header_"), k))
    return requests.select(
        "seq", F.lit(tenant).alias("tenant_id"), F.lit(dataset).alias("dataset_id"), F.lit("http").alias("input"),
        F.make_valid_utf8(F.col("body").cast("string")).alias("data"), F.lit(hint or "raw").alias("data_hint"), F.map_concat(base, x).alias("metadata"),
        F.col("ts"), F.col("remote_addr").alias("source_ip"), F.lit(data_format).alias("data_format"))


def datagram_payload(data: Column) -> Column:
    """SRC-07: NULs trimmed at both ends; NULL when nothing is left."""
    p = TX.trim_nul(data)
    return F.when(F.length(p) > 0, p)


def tcp_frames(df: DataFrame, stream: str = "stream", delimiter: str = "\n") -> DataFrame:
    """SRC-08: a connection's byte stream -> records. Cut at the *first*
    delimiter character; bytes after the last delimiter (EOF) are dropped;
    each record is right-trimmed of delimiter characters and NUL, then
    whitespace-trimmed; empty records are dropped. Adds ``frame_no``."""
    import re
    cut = re.escape(delimiter[0])
    parts = F.split(F.col(stream), cut, -1)
    complete = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rtrim_set = "[" + re.escape(delimiter + "\x00") + "]+\\z"
    cols = [c for c in df.columns if c != stream]
    f = df.select(*cols, F.posexplode(complete).alias("frame_no", "frame"))
    f = f.withColumn("frame", TX.unicode_trim(F.regexp_replace("frame", rtrim_set, "")))
    return f.where(F.col("frame") != "")


def multipart_payload(parts: Column, socket_type: Column) -> Column:
    """SRC-09: SUB sockets carry (topic, payload) frames: take part 2 when
    there are at least two parts, else part 1; other sockets the one part."""
    return F.when((socket_type == "SUB") & (F.size(parts) >= 2), parts[1]).otherwise(parts[0])


# --- file-shaped sources (SRC-10..13) ---------------------------------------------


def scan_spool(spark: SparkSession, root: str) -> DataFrame:
    """SRC-10: list every file under a spool root (recursive). Only path,
    length and modification time are selected, so file contents are never
    read (the binaryFile source prunes the content column)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime")))


SPOOL_META_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()), T.StructField("bearer_token", T.StringType()),
    T.StructField("filename", T.StringType()), T.StructField("compressed_size", T.LongType()),
    T.StructField("uncompressed_size", T.LongType()), T.StructField("line_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("last_retry", T.TimestampType()),
    T.StructField("retry_count", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("failure_reason", T.StringType()), T.StructField("trigger_reason", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def scan_metadata(spark: SparkSession, root: str, pattern: str = "*.meta") -> DataFrame:
    """SRC-11: every JSON metadata document (files named like ``pattern``)
    outside DLQ directories; unreadable documents are skipped."""
    df = (spark.read.schema(SPOOL_META_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", pattern)
          .option("recursiveFileLookup", "true").json(root)
          .withColumn("meta_path", F.input_file_name()))
    return df.where(F.col("_corrupt_record").isNull() & ~F.col("meta_path").contains("/dlq/")).drop("_corrupt_record")


def scan_batches(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: lines of (gzip) batch files with their file; ``.gz`` is
    decompressed transparently."""
    return spark.read.text(path).withColumn("file", F.input_file_name())


def batch_file_stats(lines: DataFrame) -> DataFrame:
    """FMT-16/17 over SRC-12: per batch file, non-blank lines and the
    uncompressed size (each line plus its newline)."""
    return lines.groupBy("file").agg(
        F.count_if(~TX.is_blank("value")).alias("line_count"),
        F.sum(F.octet_length("value") + 1).cast("long").alias("uncompressed_bytes"))


CONTROL_SCHEMA = T.StructType([
    T.StructField("tenants", T.ArrayType(T.StructType([
        T.StructField("tenant", T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
                                              T.StructField("active", T.BooleanType())])),
        T.StructField("datasets", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
            T.StructField("active", T.BooleanType()),
            T.StructField("config", T.StructType([T.StructField("source", T.StructType([
                T.StructField("type", T.StringType()),
                T.StructField("custom", T.MapType(T.StringType(), T.StringType()))]))])),
        ]))),
    ]))),
    T.StructField("receivers", T.ArrayType(T.StructType([
        T.StructField("instance_id", T.StringType()), T.StructField("instance_api", T.StringType()),
        T.StructField("max_payload_size", T.LongType())]))),
    T.StructField("plugin_configs", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("config_hash", T.StringType()),
])


def read_control_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: control documents (account form: tenants, datasets,
    receivers; tenant form: plugin_configs + hash), one JSON per file."""
    return spark.read.schema(CONTROL_SCHEMA).option("multiLine", "true").json(path)


def control_to_doc(docs: DataFrame) -> DataFrame:
    """Flatten control documents into the (tenant_id, tenant_name, active, datasets)
    shape consumed by ``configs.expand_control_doc``."""
    t = docs.select(F.explode("tenants").alias("t"))
    return t.select(
        F.col("t.tenant.id").alias("tenant_id"), F.col("t.tenant.name").alias("tenant_name"),
        F.col("t.tenant.active").alias("active"),
        F.transform("t.datasets", lambda d: F.struct(
            d["id"].alias("dataset_id"), d["name"].alias("name"), d["active"].alias("active"), d["config"].alias("config"),
            F.lit(None).cast("long").alias("pos"))).alias("datasets"))
