"""Queries for naming / classification functions (PRJ-*), record adapters
(SRC-01..09), admission (VAL-06) and sinks (SNK-01/04/05/06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import text as T
from ..operators import admission, delivery, framing
from ..sinks import spool as S
from ..sources import adapters as A
from ..sources import fixtures as fx
from . import ingest
from .catalog import register
from .oracle_fixtures import outcome_sql, with_fixtures

_HINTS = ("CASE event_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'nginx' WHEN 2 THEN 'syslog' WHEN 3 THEN 'tsv' "
          "WHEN 4 THEN 'raw' WHEN 5 THEN '' WHEN 6 THEN event_type ELSE event_type || '-extended' END")


@register("prj01_hint_extension", f"""
SELECT event_id, hint, CASE WHEN hint IN ('ndjson', 'json') THEN 'ndjson'
  WHEN hint IN ('syslog', 'apache', 'nginx', 'iis', 'squid') THEN 'log' WHEN hint IN ('csv', 'tsv', 'raw') THEN hint
  WHEN hint <> '' AND strlen(hint) <= 10 THEN hint ELSE 'raw' END AS ext
FROM (SELECT event_id, {_HINTS} AS hint FROM events)""")
def q_hint_extension(spark, sf):
    """PRJ-01: data hint -> raw-file extension."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(_HINTS.replace("||", "||")).alias("hint"))
    return e.select("event_id", "hint", N.hint_to_extension("hint").alias("ext"))


@register("prj02_filename_hint", with_fixtures("""
SELECT okey, lno, pkey, name,
  CASE WHEN NOT contains(name, '.') OR suffix(name, '.') THEN 'txt'
       WHEN split_part(name, '.', -1) = 'log' THEN 'syslog' WHEN split_part(name, '.', -1) = 'txt' THEN 'raw'
       ELSE split_part(name, '.', -1) END AS hint,
  CASE WHEN len(string_split(CASE WHEN contains(name, '.') THEN left(name, strlen(name) - strlen(split_part(name, '.', -1)) - 1) ELSE name END, '_')) = 3
        AND regexp_matches(string_split(CASE WHEN contains(name, '.') THEN left(name, strlen(name) - strlen(split_part(name, '.', -1)) - 1) ELSE name END, '_')[3], '^[+-]?[0-9]+$')
       THEN coalesce(TRY_CAST(string_split(CASE WHEN contains(name, '.') THEN left(name, strlen(name) - strlen(split_part(name, '.', -1)) - 1) ELSE name END, '_')[3] AS INT), 0)
       ELSE 0 END AS expected_lines
FROM raw_names"""))
def q_filename_hint(spark, sf):
    """PRJ-02 + PRJ-05: raw-file name -> hint and expected line count."""
    r = fx.raw_names(spark, sf)
    return r.select("okey", "lno", "pkey", "name", N.filename_to_hint("name").alias("hint"),
                    N.filename_line_count("name").alias("expected_lines"))


@register("prj06_line_verify", with_fixtures("""
SELECT okey, lno, pkey, expected > 0 AND expected <> actual_lines AS mismatch FROM (
  SELECT *, CASE WHEN regexp_matches(name, '^[0-9]+_[0-9]+_[0-9]+(\\.[a-z]+)?$')
    THEN CAST(string_split(regexp_replace(name, '\\.[a-z]+$', ''), '_')[3] AS INT) ELSE 0 END AS expected
  FROM raw_names)"""))
def q_line_verify(spark, sf):
    """PRJ-06: expected (from the name) vs actual line counts."""
    r = fx.raw_names(spark, sf)
    return r.select("okey", "lno", "pkey",
                    N.line_count_mismatch(N.filename_line_count("name"), F.col("actual_lines")).alias("mismatch"))


@register("prj03_batch_names", with_fixtures("""
SELECT id, tenant_id || '--' || dataset_id || '--' || (epoch_us(created_at) * 1000 + okey) || '--' || data_hint || '.gz' AS filename,
  data_hint AS hint_back, data_hint AS legacy_hint, '' AS bare_hint
FROM spool_files"""))
def q_batch_names(spark, sf):
    """PRJ-03 + PRJ-04: batch names generated and parsed back (new,
    legacy ``batch_<n>.<hint>.gz`` and bare ``batch_<n>.gz`` forms)."""
    f = fx.spool_files(spark, sf)
    nanos = F.unix_micros(F.col("created_at").cast("timestamp")) * 1000 + F.col("okey")
    name = N.batch_filename("tenant_id", "dataset_id", nanos, "data_hint")
    legacy = F.concat(F.lit("/spool/x/batch_"), F.col("okey").cast("string"), F.lit("."), F.col("data_hint"), F.lit(".gz"))
    bare = F.concat(F.lit("batch_"), F.col("okey").cast("string"), F.lit(".gz"))
    return f.select("id", name.alias("filename"), N.batch_filename_to_hint(name).alias("hint_back"),
                    N.batch_filename_to_hint(legacy).alias("legacy_hint"), N.batch_filename_to_hint(bare).alias("bare_hint"))


@register("prj07_outcomes", with_fixtures(f"""
SELECT status_code, {outcome_sql('status_code')} AS outcome, count(*) AS attempts FROM attempts GROUP BY ALL"""))
def q_outcomes(spark, sf):
    """PRJ-07: status code -> success / permanent / transient."""
    a = fx.attempts(spark, sf)
    return a.groupBy("status_code", N.delivery_outcome(F.col("status_code")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("attempts"))


@register("prj08_masking", """
SELECT c_custkey, s,
  CASE WHEN length(s) = 0 THEN s WHEN length(s) <= 4 THEN '****' ELSE left(s, 2) || '****' || right(s, 2) END AS mask_a,
  CASE WHEN length(s) = 0 THEN s WHEN length(s) <= 8 THEN '***' ELSE left(s, 4) || '***' || right(s, 4) END AS mask_b
FROM (SELECT c_custkey, substring(c_name, 1, CAST(c_custkey % 20 AS INT)) AS s FROM customer)""")
def q_masking(spark, sf):
    """PRJ-08: the two secret-masking rules."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", F.expr("substring(c_name, 1, cast(c_custkey % 20 as int))").alias("s"))
    return c.select("c_custkey", "s", N.mask_short("s").alias("mask_a"), N.mask_long("s").alias("mask_b"))


@register("prj09_to_int", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT)
  WHEN 1 THEN CAST(trunc(value) AS BIGINT) WHEN 3 THEN CAST(trunc(-value * 1000) AS BIGINT) END AS value,
  event_id % 4 <> 2 AS ok
FROM events""")
def q_to_int(spark, sf):
    """PRJ-09: numeric coercion of JSON values (ints, floats, strings)."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    v = (F.when(F.col("event_id") % 4 == 0, F.variant_get(F.parse_json("props"), "$.k", "variant"))
         .when(F.col("event_id") % 4 == 1, F.parse_json(F.col("value").cast("string")))
         .when(F.col("event_id") % 4 == 2, F.parse_json(F.lit('"abc"')))
         .otherwise(F.parse_json((-F.col("value") * 1000).cast("string"))))
    r = e.select("event_id", N.to_int(v).alias("r"))
    return r.select("event_id", F.col("r.value").alias("value"), F.col("r.ok").alias("ok"))


@register("prj11_human_bytes", with_fixtures("""
SELECT id, CASE WHEN size >= 1048576 THEN (size // 1048576) || 'MB' WHEN size >= 1024 THEN (size // 1024) || 'KB'
  ELSE size || ' bytes' END AS human FROM (SELECT id, size // (1 + okey % 300) AS size FROM spool_files)"""))
def q_human_bytes(spark, sf):
    """PRJ-11: human-readable byte sizes."""
    f = fx.spool_files(spark, sf).select("id", (F.col("size") / (1 + F.col("okey") % 300)).cast("long").alias("size"))
    return f.select("id", N.human_bytes("size").alias("human"))


@register("prj12_mask_config", with_fixtures("""
SELECT pos, CASE WHEN bearer_token IS NULL THEN NULL ELSE '***MASKED***' END AS bearer_token, dataset_id
FROM local_inputs"""))
def q_mask_config(spark, sf):
    """PRJ-12: sensitive keys of a config map masked."""
    m = fx.local_inputs(spark, sf).select("pos", N.mask_config("config").alias("c"))
    return m.select("pos", F.element_at("c", F.lit("bearer_token")).alias("bearer_token"),
                    F.element_at("c", F.lit("dataset_id")).alias("dataset_id"))


@register("prj10_ip_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4
  WHEN 0 THEN ((a >> 24) & 255) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255)
  WHEN 1 THEN ((b >> 24) & 255) || '.' || ((b >> 16) & 255) || '.' || ((b >> 8) & 255) || '.' || (b & 255)
  WHEN 2 THEN '2001:db8::' || CASE WHEN l_partkey >= 65536 THEN lower(printf('%x', l_partkey >> 16)) || ':' || lower(printf('%x', l_partkey & 65535))
                                   WHEN l_partkey > 0 THEN lower(printf('%x', l_partkey)) ELSE '' END
  ELSE base64(unhex(printf('%010X', l_orderkey))) END AS ip
FROM (SELECT *, l_partkey * 65537 % 4294967296 AS a, l_suppkey * 16843009 % 4294967296 AS b FROM lineitem)""")
def q_ip_text(spark, sf):
    """PRJ-10: address bytes built from line items rendered as text."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    hx = F.expr("CASE l_linenumber % 4 WHEN 0 THEN lpad(hex(l_partkey * 65537 % 4294967296), 8, '0') "
                "WHEN 1 THEN concat('00000000000000000000FFFF', lpad(hex(l_suppkey * 16843009 % 4294967296), 8, '0')) "
                "WHEN 2 THEN concat('20010DB8', repeat('0', 16), lpad(hex(l_partkey), 8, '0')) "
                "ELSE lpad(hex(l_orderkey), 10, '0') END")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", F.unhex(hx).alias("address"))
    return N.with_ip_text(a, "address", "ip").drop("address")


@register("e2e_kafka_landing", """
SELECT 't' AS tenant_id, 'd' AS dataset_id, count(*) AS lines, 0 AS wrapped_lines, count(*) AS stamped_lines,
  CAST(sum(strlen(props)) AS BIGINT) AS bytes_in
FROM events""")
def q_kafka_landing(spark, sf):
    """SRC-02 to FMT-14 in one plan: records, messages, landed lines."""
    m = A.kafka_to_messages(fx.kafka_records(spark, sf), "t", "d", hint="ndjson")
    return ingest.dataset_line_summary(ingest.land_lines(m))


@register("src02_kafka", """
SELECT event_id AS seq, event_type AS topic, CAST(user_id % 4 AS VARCHAR) AS "partition",
  CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS VARCHAR) AS "offset",
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS "key",
  't' || event_id AS header_trace, 'u' || user_id AS header_src, 'kafka' AS plugin, props AS data
FROM events""")
def q_kafka(spark, sf):
    """SRC-02: Kafka records -> messages with metadata."""
    r = fx.kafka_records(spark, sf)
    m = A.kafka_to_messages(r.withColumnRenamed("event_id", "eid"), "t", "d").withColumn("md", F.col("metadata"))
    md = F.col("metadata")
    return m.select(*[F.element_at(md, F.lit(k)).alias(k) for k in ("topic", "partition", "offset", "key")],
                    F.element_at(md, F.lit("header_trace")).alias("header_trace"),
                    F.element_at(md, F.lit("header_src")).alias("header_src"),
                    F.element_at(md, F.lit("plugin")).alias("plugin"), "data",
                    F.regexp_extract(F.element_at(md, F.lit("header_trace")), r"(\d+)", 1).cast("long").alias("seq"))


@register("src03_nats", """
SELECT event_id AS seq, 'events.' || event_type AS subject, CASE WHEN event_id % 3 = 0 THEN 'inbox.' || user_id END AS reply,
  'q1' AS queue_group, 't' || event_id AS header_trace, CAST(NULL AS VARCHAR) AS header_empty, CAST(map_size_hint AS BIGINT) AS metadata_keys
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 5 ELSE 4 END AS map_size_hint FROM events)""")
def q_nats(spark, sf):
    """SRC-03: NATS records -> messages (first header value, optional reply)."""
    m = A.nats_to_messages(fx.nats_records(spark, sf), "t", "d", queue_group="q1")
    md = F.col("metadata")
    return m.select("seq", F.element_at(md, F.lit("subject")).alias("subject"),
                    F.element_at(md, F.lit("reply")).alias("reply"), F.element_at(md, F.lit("queue_group")).alias("queue_group"),
                    F.element_at(md, F.lit("header_Trace")).alias("header_trace"),
                    F.element_at(md, F.lit("header_Empty")).alias("header_empty"),
                    F.size(md).cast("long").alias("metadata_keys"))


@register("src04_sqs_lines", f"""
SELECT doc_id AS seq, count(*) AS lines FROM documents, unnest(string_split(text, chr(10))) AS t(line)
WHERE doc_id % 17 <> 0 AND NOT regexp_full_match(t.line, '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]*') GROUP BY doc_id""")
def q_sqs_lines(spark, sf):
    """SRC-04 + FMT-01: SQS bodies framed into lines (NULL bodies dropped)."""
    from ..operators import framing
    m = A.sqs_to_messages(fx.sqs_records(spark, sf), "t", "d")
    return framing.split_lines(m).groupBy("seq").agg(F.count(F.lit(1)).alias("lines"))


@register("src05_kinesis", """
SELECT 'shard-' || (user_id % 4) AS shard_id, count(*) AS records, max(event_id) AS last_sequence FROM events GROUP BY 1""")
def q_kinesis(spark, sf):
    """SRC-05 + AGG-10: Kinesis records per shard with the last sequence."""
    r = fx.kinesis_records(spark, sf)
    m = A.kinesis_to_messages(r, "t", "d").withColumn("shard_id", F.element_at("metadata", F.lit("shard_id")))
    return m.groupBy("shard_id").agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_sequence"))


_NL_OFFSETS = ("list_transform(generate_series(1, len(string_split(body, chr(10))) - 1), "
               "lambda i: list_sum(list_transform(string_split(body, chr(10))[1:i], lambda x: strlen(x) + 1)))")


@register("val06_admission", with_fixtures(f"""
SELECT seq, CASE WHEN method <> 'POST' THEN 405 WHEN auth_header <> 'Bearer secret' THEN 401
  WHEN declared_length > 20000 THEN 413 WHEN lines > 2 THEN 413 ELSE 200 END AS code,
  CASE WHEN method <> 'POST' THEN 'method_not_allowed' WHEN auth_header <> 'Bearer secret' THEN 'unauthorized'
  WHEN declared_length > 20000 THEN 'payload_too_large' WHEN lines > 2 THEN 'too_many_lines' ELSE 'accepted' END AS reason,
  CAST(least(strlen(body), 20000) AS BIGINT) AS body_bytes
FROM (SELECT *, 1 + len(list_filter({_NL_OFFSETS}, lambda o: o <= 20000)) AS lines FROM http_requests)"""))
def q_admission(spark, sf):
    """VAL-06: webhook admission ladder (limits: 20000 bytes, 2 lines)."""
    a = admission.admit_requests(fx.http_requests(spark, sf), bearer_token="secret", max_payload=20000, max_lines=2)
    return a.select("seq", "code", "reason", F.octet_length("body").cast("long").alias("body_bytes"))


@register("src06_http", with_fixtures("""
SELECT seq, 'text/html' AS content_type, user_agent, 'POST' AS method, '/ingest' AS path, x_request_id AS "header_x-request-id",
  x_source AS "header_x-source", 'secret' AS bearer_token
FROM http_requests WHERE method = 'POST' AND auth_header = 'Bearer secret' AND declared_length <= 20000"""))
def q_http(spark, sf):
    """SRC-06: accepted requests -> messages with request metadata."""
    a = admission.admit_requests(fx.http_requests(spark, sf), bearer_token="secret", max_payload=20000, max_lines=10_000)
    m = A.http_to_messages(a.where("code = 200"), "t", "d", bearer_token="secret")
    md = F.col("metadata")
    return m.select("seq", *[F.element_at(md, F.lit(k)).alias(k) for k in
                             ("content_type", "user_agent", "method", "path", "header_x-request-id", "header_x-source",
                              "bearer_token")])


@register("src07_datagram", """
SELECT doc_id AS seq, CAST(strlen(text) AS BIGINT) AS payload_bytes FROM documents WHERE strlen(text) > 0""")
def q_datagram(spark, sf):
    """SRC-07: NUL-padded datagrams trimmed; empty ones dropped."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("\x00\x00"), F.col("text"), F.lit("\x00")).alias("data"))
    p = d.select("seq", A.datagram_payload(F.col("data")).alias("payload")).where(F.col("payload").isNotNull())
    return p.select("seq", F.octet_length("payload").cast("long").alias("payload_bytes"))


@register("src08_tcp_frames", """
SELECT doc_id AS seq, count(*) AS frames, CAST(sum(strlen(f)) AS BIGINT) AS bytes FROM (
  SELECT doc_id, regexp_replace(regexp_replace(t.line, '[\\n\\x00]+$', ''),
           '^[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+$', '', 'g') AS f
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, pos)
  WHERE t.pos < len(string_split(text, chr(10))))
WHERE f <> '' GROUP BY doc_id""")
def q_tcp_frames(spark, sf):
    """SRC-08: documents as TCP byte streams (unterminated tail dropped)."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("text").alias("stream"))
    f = A.tcp_frames(d, "stream", "\n")
    return f.groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("frame")).cast("long").alias("bytes"))


@register("src09_multipart", """
SELECT page_id AS seq, md5(CASE WHEN page_id % 3 <> 1 AND page_id % 2 = 0 THEN html
                                WHEN page_id % 2 = 0 THEN url ELSE html END) AS digest FROM pages""")
def q_multipart(spark, sf):
    """SRC-09: the payload frame of multipart messages by socket type."""
    m = fx.multipart_messages(spark, sf)
    return m.select("seq", F.md5(A.multipart_payload(F.col("parts"), F.col("socket_type"))).alias("digest"))


@register("snk01_raw_names", with_fixtures(f"""
SELECT seq, ext, lines, CASE WHEN data_hint IN ('ndjson', 'json') THEN NULL ELSE CAST(strlen(data) AS BIGINT) END AS bytes,
  CASE WHEN data_hint IN ('ndjson', 'json') THEN NULL
       ELSE (epoch_us(ts) * 1000 + seq % 1000) || '_' || strlen(data) || '_' || lines || '.' || ext END AS raw_name
FROM (SELECT *, CASE WHEN data_hint IN ('ndjson', 'json') THEN 'ndjson' WHEN data_hint IN ('syslog', 'apache', 'nginx', 'iis', 'squid') THEN 'log'
        WHEN data_hint IN ('csv', 'tsv', 'raw') THEN data_hint WHEN data_hint <> '' AND strlen(data_hint) <= 10 THEN data_hint ELSE 'raw' END AS ext,
        CAST((SELECT count(*) FROM unnest(string_split(data, chr(10))) AS t(l)
              WHERE NOT regexp_full_match(l, '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]*')) AS INT) AS lines
      FROM messages)"""))
def q_raw_names(spark, sf):
    """SNK-01: raw-file name parts after stamping (bytes checked for
    non-JSON hints, whose payload is not re-serialised)."""
    m = fx.messages(spark, sf)
    lines = framing.stamp(framing.split_lines(m.where(F.col("data_hint").isin("ndjson", "json"))), line="line")
    # The lines of one message: a bounded group.
    joined = lines.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("line_no", "stamped"))).alias("ls")) \
        .select("seq", F.array_join("ls.stamped", "\n").alias("again"))
    m = m.join(joined, "seq", "left").withColumn("data", F.coalesce("again", "data")).drop("again")
    r = S.raw_name_parts(m)
    js = F.col("data_hint").isin("ndjson", "json")
    return r.select("seq", "ext", "lines", F.when(js, F.lit(None).cast("long")).otherwise(F.col("bytes")).alias("bytes"),
                    F.when(js, F.lit(None).cast("string")).otherwise(F.col("raw_name")).alias("raw_name"))


@register("snk04_queue_names", with_fixtures("""
SELECT id, CASE WHEN okey % 5 = 0 THEN 'tenant0--ds1--' || (epoch_us(created_at) * 1000) || '--' || data_hint || '.gz'
  ELSE id || '.gz' END AS queue_file
FROM spool_files"""))
def q_queue_names(spark, sf):
    """SNK-04: queue file names (ids with ``--`` kept; others generated)."""
    f = fx.spool_files(spark, sf)
    bid = F.when(F.col("okey") % 5 == 0, F.concat(F.lit("b"), F.col("okey").cast("string"))).otherwise(F.col("id"))
    name = S.queue_filename(bid, F.lit("tenant0"), F.lit("ds1"), F.unix_micros(F.col("created_at").cast("timestamp")) * 1000,
                            F.col("data_hint"))
    return f.select("id", name.alias("queue_file"))


@register("snk05_manifest", with_fixtures("""
SELECT id, 'https://recv.example/' || tenant_id || '/' || dataset_id AS url, 'Bearer ' || bearer_token AS authorization,
  CAST(line_count AS VARCHAR) AS line_count, CAST(size AS VARCHAR) AS original_bytes,
  strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, data_hint, split_part(path, '/', 4) AS filename
FROM spool_files"""))
def q_manifest(spark, sf):
    """SNK-05: delivery request manifest (URL and headers)."""
    m = S.delivery_manifest(fx.spool_files(spark, sf), "https://recv.example/", global_token="g")
    h = F.col("headers")
    return m.select("id", "url", F.element_at(h, F.lit("Authorization")).alias("authorization"),
                    F.element_at(h, F.lit("X-Batch-Line-Count")).alias("line_count"),
                    F.element_at(h, F.lit("X-Batch-Original-Bytes")).alias("original_bytes"),
                    F.element_at(h, F.lit("X-Batch-Created-At")).alias("created_at"),
                    F.element_at(h, F.lit("X-Batch-Data-Hint")).alias("data_hint"),
                    F.element_at(h, F.lit("X-Batch-Filename")).alias("filename"))


@register("snk06_source_archive", with_fixtures(f"""
SELECT id, tenant_id || '/' || dataset_id || '/src/' || split_part(path, '/', 4) AS archive_path,
  md5(array_to_string(list_sort([
     'Authorization: Bearer ' || bearer_token, 'Content-Encoding: gzip', 'Content-Type: application/octet-stream',
     'User-Agent: tidewater/0.1.0', 'X-Batch-ID: ' || id, 'X-Batch-Created-At: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'),
     'X-Batch-Data-Hint: ' || data_hint, 'X-Batch-Filename: ' || split_part(path, '/', 4),
     'X-Batch-Line-Count: ' || line_count, 'X-Batch-Original-Bytes: ' || size]), chr(10)) || chr(10)) AS headers_md5
FROM spool_files f JOIN (SELECT okey, status_code FROM attempts WHERE attempt_no = 1) a USING (okey)
WHERE f.state = 'queue' AND {outcome_sql('a.status_code')} = 'success'"""))
def q_source_archive(spark, sf):
    """SNK-06: archive rows (path + sorted header text) of delivered batches."""
    files = fx.spool_files(spark, sf)
    step = delivery.queue_step(files, fx.attempts(spark, sf).where("attempt_no = 1"))
    m = S.delivery_manifest(files, "https://recv.example", global_token="g")
    arch = S.source_archive(m, step)
    return arch.select("id", "archive_path", F.md5("headers_text").alias("headers_md5"))


@register("agg10_topic_partitions", """
SELECT event_type AS topic, count(*) AS received, CAST(sum(strlen(props)) AS BIGINT) AS bytes,
  CAST(arg_max(user_id % 4, (ts, event_id)) AS INT) AS last_partition
FROM events GROUP BY event_type""")
def q_topic_partitions(spark, sf):
    """AGG-10: per Kafka topic: messages, bytes and the last partition seen."""
    r = fx.kafka_records(spark, sf)
    return r.groupBy("topic").agg(
        F.count(F.lit(1)).alias("received"), F.sum(F.octet_length("value")).cast("long").alias("bytes"),
        F.max_by("partition", F.struct("timestamp", "event_id")).alias("last_partition"))


@register("agg10_subject_counts", """
SELECT 'events.' || event_type AS subject, count(*) AS received FROM events GROUP BY 1""")
def q_subject_counts(spark, sf):
    """AGG-10: per NATS subject message counts (from the message metadata)."""
    m = A.nats_to_messages(fx.nats_records(spark, sf), "t", "d")
    return m.groupBy(F.element_at("metadata", F.lit("subject")).alias("subject")).agg(F.count(F.lit(1)).alias("received"))
