"""Queries that write to a fresh shared folder and read back (SRC-12/13,
FMT-17, SNK-02/03), safe names (VAL-08) and the extension points (EXT-01..03)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import registry
from ..functions import ident
from ..operators import configs as C
from ..operators import framing
from ..session import checkpoint_dir
from ..sinks import batch_table
from ..sinks import spool as S
from ..sources import adapters as A
from ..sources import fixtures as fx
from ..sources.tables import table
from ..streaming import jobs
from . import ingest
from .catalog import register
from .config_queries import TOKEN, _flat
from .oracle_fixtures import outcome_sql, with_fixtures

_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@register("src11_metadata_scan", with_fixtures("""
SELECT id, tenant_id, dataset_id, size AS compressed_size, line_count, retry_count, status, trigger_reason
FROM spool_files WHERE state <> 'dlq' AND okey % 19 <> 0"""))
def q_metadata_scan(spark, sf):
    """SRC-11: metadata documents of all spool files written as JSON, some of
    them broken, some in a DLQ folder, and scanned."""
    path = _folder(spark)
    f = fx.spool_files(spark, sf)
    doc = F.to_json(F.struct("id", "tenant_id", "dataset_id", F.col("size").alias("compressed_size"), "line_count",
                             "retry_count", "status", "trigger_reason"))
    text = f.select((F.col("state") == "dlq").alias("dead"),
                    F.when(F.col("okey") % 19 == 0, F.substring(doc, 1, 20)).otherwise(doc).alias("value"))
    for dead, folder in ((False, "retry"), (True, "dlq")):
        text.where(F.col("dead") == dead).select("value").write.text(f"{path}/{folder}")
    m = A.scan_metadata(spark, path, "part-*")
    return m.select("id", "tenant_id", "dataset_id", "compressed_size", "line_count", "retry_count", "status", "trigger_reason")


@register("src12_batch_files", f"""
SELECT lang, count(*) FILTER (WHERE NOT regexp_full_match(t.l, '{_WS}*')) AS line_count,
  CAST(sum(strlen(t.l) + 1) AS BIGINT) AS uncompressed_bytes
FROM documents, unnest(string_split(text, chr(10))) AS t(l) GROUP BY lang""")
def q_batch_files(spark, sf):
    """SRC-12 + FMT-16/17: gzip text files of all documents written per
    language, scanned, and counted per file."""
    path = _folder(spark)
    table(spark, sf, "documents", "lang", "text").write.partitionBy("lang").option("compression", "gzip").text(path)
    stats = A.batch_file_stats(A.scan_batches(spark, path))
    lang = F.regexp_extract("file", "lang=([^/]+)", 1)
    return stats.groupBy(lang.alias("lang")).agg(F.sum("line_count").cast("long").alias("line_count"),
                                                 F.sum("uncompressed_bytes").cast("long").alias("uncompressed_bytes"))


@register("src13_control_documents", with_fixtures("SELECT * EXCLUDE (pos) FROM configs_flat"))
def q_control_documents(spark, sf):
    """SRC-13 + JON-01: control documents written as JSON files, one a file,
    read with the fixed schema and expanded."""
    path = _folder(spark)
    docs = _account_documents(fx.control_doc(spark, sf))
    # A file costs more than its bytes: the number of tasks is explicit, as
    # runtime coalescing goes by bytes.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.repartition(n).write.option("maxRecordsPerFile", 1).json(path)
    docs = A.control_to_doc(A.read_control_documents(spark, path))
    return _flat(C.expand_control_doc(docs, bearer_token=TOKEN)).drop("pos")


def _account_documents(doc):
    """Control documents of the account form: one per page, with the datasets
    that each tenant has on it. A tenant without datasets gets its own, so a
    document is as large as its page's datasets at most."""
    tenant = F.struct(F.col("tenant_id").alias("id"), F.col("tenant_name").alias("name"), "active")
    sets = F.transform("datasets", lambda d: F.struct(d["dataset_id"].alias("id"), d["name"].alias("name"),
                                                      d["active"].alias("active"), d["config"].alias("config")))
    alone = F.when(F.size("datasets") == 0, F.col("tenant_id")).alias("alone")
    return doc.groupBy("page", alone).agg(F.collect_list(F.struct(tenant.alias("tenant"), sets.alias("datasets"))).alias("tenants")) \
        .select("tenants")


@register("snk02_layouts", with_fixtures("""
SELECT 'flat' AS layout, '' AS folder, count(*) AS messages FROM messages
UNION ALL SELECT 'tenant_dataset', 'tenant_id=' || tenant_id || '/dataset_id=' || dataset_id, count(*) FROM messages GROUP BY ALL
UNION ALL SELECT 'date_tenant', 'year=' || strftime(ts, '%Y') || '/month=' || strftime(ts, '%m') || '/day=' || strftime(ts, '%d')
  || '/tenant_id=' || tenant_id || '/dataset_id=' || dataset_id, count(*) FROM messages GROUP BY ALL
UNION ALL SELECT 'protocol_tenant', 'protocol=data/tenant_id=' || tenant_id || '/dataset_id=' || dataset_id, count(*)
  FROM messages GROUP BY ALL"""))
def q_layouts(spark, sf):
    """SNK-02: all messages landed in every layout; rows found per folder."""
    out = None
    for layout in S.LAYOUT_COLUMNS:
        path = _folder(spark)
        S.write_raw(fx.messages(spark, sf).select("seq", "tenant_id", "dataset_id", "ts"), path, layout)
        folder = F.regexp_extract(F.input_file_name(), path.rsplit("/", 1)[1] + "/(?:(.*)/)?[^/]+$", 1)
        part = spark.read.option("recursiveFileLookup", "true").parquet(path).select(folder.alias("folder")) \
            .groupBy("folder").agg(F.count(F.lit(1)).alias("messages")).withColumn("layout", F.lit(layout))
        out = part if out is None else out.unionByName(part)
    return out


@register("snk03_batch_objects", with_fixtures("""
SELECT tenant_id, dataset_id, data_hint, seq // 1000 AS batch_no, count(*) AS line_count,
  CAST(sum(strlen(line) + 1) AS BIGINT) AS uncompressed_bytes, md5(string_agg(line, chr(10) ORDER BY seq, line_no)) AS content
FROM lines GROUP BY ALL"""))
def q_batch_objects(spark, sf):
    """SNK-03: one gzip object per batch of messages, read back in order."""
    path = _folder(spark)
    lines = framing.split_lines(fx.messages(spark, sf)).withColumn("batch_no", F.expr("seq div 1000"))
    keys = ["tenant_id", "dataset_id", "data_hint", "batch_no"]
    S.write_batches(lines.select(*keys, "seq", "line_no", "line"), path)
    back = S.read_batches(spark, path)
    text = F.regexp_replace("value", "\n$", "")
    return back.select(*keys,
                       (F.size(F.split("value", "\n", -1)) - 1).cast("long").alias("line_count"),
                       F.octet_length("value").cast("long").alias("uncompressed_bytes"), F.md5(text).alias("content"))


@register("val08_safe_names", """
SELECT p_partkey, name, NOT regexp_matches(name, '\\.\\.|/|\\\\') AS safe
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '../' || p_name WHEN 1 THEN p_name || '/x' WHEN 2 THEN p_name || '\\x'
        WHEN 3 THEN p_name || '..gz' ELSE p_name || '.gz' END AS name FROM part)""")
def q_safe_names(spark, sf):
    """VAL-08: names that leave their folder are refused."""
    p = table(spark, sf, "part", "p_partkey", "p_name")
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("../"), n)).when(k == 1, F.concat(n, F.lit("/x"))).when(k == 2, F.concat(n, F.lit("\\x"))) \
        .when(k == 3, F.concat(n, F.lit("..gz"))).otherwise(F.concat(n, F.lit(".gz")))
    return p.select("p_partkey", name.alias("name")).withColumn("safe", ident.is_safe_filename("name"))


@register("ext01_registered_input", """
SELECT event_type AS topic, 't' AS tenant_id, 'd' AS dataset_id, 'ndjson' AS data_hint, count(*) AS messages,
  CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type""")
def q_registered_input(spark, sf):
    """EXT-01: an input transform looked up by name."""
    m = fx.kafka_records(spark, sf).transform(registry.create_input("kafka", tenant_id="t", dataset_id="d", data_hint="ndjson"))
    return m.groupBy(F.element_at("metadata", F.lit("topic")).alias("topic"), "tenant_id", "dataset_id", "data_hint").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))


@register("ext02_field_errors", with_fixtures("""
SELECT pos, type, 'in' || pos AS name, f || ': needed' AS error
FROM (SELECT pos, type, unnest(CASE WHEN type = 'kafka' THEN ['brokers', 'topics', 'group_id'] WHEN type = 'nats' THEN ['subjects']
        WHEN type = 'sqs' THEN ['queue_name', 'region'] WHEN type = 'kinesis' THEN ['stream_name', 'region']
        ELSE [] END) AS f FROM local_inputs)"""))
def q_field_errors(spark, sf):
    """EXT-02: required fields that the configured inputs lack."""
    return registry.config_field_errors(fx.local_inputs(spark, sf))


@register("ext03_formatter", with_fixtures("""
SELECT seq, line_no, md5(regexp_replace(line, ' {2,}', ' ', 'g')) AS generic, md5(line) AS raw FROM lines"""))
def q_formatter(spark, sf):
    """EXT-03: formatters looked up by hint."""
    lines = framing.split_lines(fx.messages(spark, sf))
    return lines.select("seq", "line_no", F.md5(registry.formatter("other")(F.col("line"))).alias("generic"),
                        F.md5(registry.formatter("")(F.col("line"))).alias("raw"))


@register("str01_ingest_stream", with_fixtures("""
SELECT tenant_id, dataset_id, count(*) AS lines, count(*) FILTER (WHERE wrapped) AS wrapped_lines,
  count(*) FILTER (WHERE is_stamped) AS stamped_lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes_in
FROM stamped GROUP BY tenant_id, dataset_id"""))
def q_ingest_stream(spark, sf):
    """STR-01: all messages landed by the streaming job, in one run over what
    is there, and summarised."""
    source, sink, state = _folder(spark), _folder(spark), _folder(spark)
    messages = fx.messages(spark, sf)
    messages.write.parquet(source)
    jobs.ingest_stream_batches(spark, source, messages.schema, sink, state).awaitTermination()
    return ingest.dataset_line_summary(spark.read.parquet(sink))


@register("str04_retry_stream", with_fixtures(f"""
WITH a AS (
  SELECT okey, count(*) AS n, arg_min({outcome_sql('status_code')}, attempt_no) AS fo,
    min(attempt_no) FILTER (WHERE {outcome_sql('status_code')} = 'success') AS fs
  FROM attempts WHERE okey IN (SELECT okey FROM spool_files WHERE state = 'queue') GROUP BY okey)
SELECT okey, CASE WHEN fo = 'success' THEN 'delivered' WHEN fo = 'permanent' THEN 'dlq'
  WHEN fs IS NOT NULL AND fs <= 5 THEN 'delivered' WHEN n >= 5 THEN 'dlq' ELSE 'retry' END AS state
FROM a"""))
def q_retry_stream(spark, sf):
    """STR-04: per-file retry state over a stream of all attempts of queue
    files, in one run over what is there; the last state of each file."""
    jobs.prepare_streaming(spark)
    source, sink, state = _folder(spark), _folder(spark), _folder(spark)
    queue = fx.spool_files(spark, sf).where("state = 'queue'").select("okey")
    attempts = fx.attempts(spark, sf).join(queue, "okey", "left_semi")
    attempts.write.parquet(source)
    stream = spark.readStream.schema(attempts.schema).parquet(source)
    jobs.retry_state_stream(stream, 5).writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("okey").agg(F.max_by("state", "attempts_used").alias("state"))


SHIP_BYTES = 2_000
_SHIP = f"""
WITH RECURSIVE items AS (
  SELECT event_type AS topic, ts, user_id % 4 AS part, event_id,
    strlen(replace(props, ' ', '')) + strlen(',"ingest_ms":' || (epoch_us(ts) // 1000)) + 1 AS size
  FROM events),
numbered AS (
  SELECT i.*, off * 16384 + part AS seq, row_number() OVER (PARTITION BY topic ORDER BY ts, off * 16384 + part) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY event_id) - 1 AS off FROM items) i),
packed AS (
  SELECT topic, rn, ts, seq, size, size AS acc, CAST(0 AS BIGINT) AS batch_no FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.topic, n.rn, n.ts, n.seq, n.size,
    CASE WHEN (p.acc + n.size) // 5 > {SHIP_BYTES} THEN n.size ELSE p.acc + n.size END,
    CASE WHEN (p.acc + n.size) // 5 > {SHIP_BYTES} THEN p.batch_no + 1 ELSE p.batch_no END
  FROM packed p JOIN numbered n ON n.topic = p.topic AND n.rn = p.rn + 1)
SELECT topic AS dataset_id, batch_no, 'https://recv.example/t/' || topic AS url, count(*) AS line_count,
  CAST(sum(size) AS BIGINT) AS total_bytes,
  't--' || topic || '--' || arg_min(epoch_us(ts) * 1000 + seq % 1000, rn) || '--ndjson.gz' AS filename
FROM packed GROUP BY topic, batch_no"""


def _by_topic(spark, sf):
    """Kafka-shaped events as messages of one tenant, a dataset per topic."""
    m = A.kafka_to_messages(fx.kafka_records(spark, sf), "t", "d", hint="ndjson", data_format="ndjson")
    return m.withColumn("dataset_id", F.element_at("metadata", F.lit("topic")))


@register("e2e_kafka_to_manifest", _SHIP)
def q_kafka_to_manifest(spark, sf):
    """SRC-02 to SNK-05: Kafka-shaped events landed, stamped, packed into
    gzip batches in a batch table, and one upload request per batch."""
    made = ingest.ship(_by_topic(spark, sf), _folder(spark), "https://recv.example", "g", SHIP_BYTES)
    return made.select("dataset_id", "batch_no", "url", "line_count", "total_bytes",
                       F.element_at("headers", F.lit("X-Batch-Filename")).alias("filename"))


@register("snk03_batch_table", with_fixtures("""
SELECT tenant_id || '--' || dataset_id AS source, data_hint, seq // 1000 AS batch_no, count(*) AS line_count,
  md5(string_agg(line, chr(10) ORDER BY seq, line_no)) AS content
FROM lines GROUP BY ALL"""))
def q_batch_table(spark, sf):
    """SNK-03: batches as gzip rows of one table, read back line by line."""
    path = _folder(spark)
    lines = framing.split_lines(fx.messages(spark, sf)).withColumn("batch_no", F.expr("seq div 1000")) \
        .withColumn("nanos", F.expr("seq div 1000"))
    batch_table.write_batch_table(batch_table.compress_batches(lines), path)
    back = batch_table.scan_batch_table(spark, path).groupBy("id").agg(
        F.count(F.lit(1)).alias("line_count"), F.first("batch_no").alias("batch_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("text"))
    part = F.split("id", "--")
    return back.select(F.concat_ws("--", part[0], part[1]).alias("source"), part[3].alias("data_hint"), "batch_no", "line_count",
                       F.md5("text").alias("content"))
