"""Deterministic operator inputs derived from the driver tables.

The landing pipeline consumes messages, spool-file metadata, delivery
attempts, configuration documents and counters. None of these are in the
driver tables directly, so each is *derived* from them with fixed rules
(no randomness, no wall clock). The DuckDB oracle derives the very same
rows with the twin SQL in ``tidewater.plans.oracle``; keep both in step.

All derivations are narrow projections (plus, for counter tables, a window
partitioned by a small key), so their cost grows linearly with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.prefix import exclusive_running_sum, running_sum, running_sums
from .tables import table

E = F.expr


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """One inbound message per event: mixed JSON / text payloads."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    txt = E("concat('user=', user_id, ' type=', event_type, ' value=', cast(round(value * 100) as bigint))")
    data = (
        F.when(E("event_id % 5 = 0"), F.col("props"))
        .when(E("event_id % 5 = 1"), txt)
        .when(E("event_id % 5 = 2"), F.concat("props", F.lit("\n"), "props"))
        .when(E("event_id % 5 = 3"), F.concat(txt, F.lit("\n  \t\n"), "props"))
        .otherwise(E("concat('{\"Ingest_Ms\": ', event_id, ', \"INGEST_MS\": ', user_id, ', \"k\": ', user_id % 100, '}')"))
    )
    return e.select(
        F.col("event_id").alias("seq"),
        E("concat('in', user_id % 4)").alias("input"),
        E("CASE user_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN '' WHEN 2 THEN 'ndjson' ELSE 'text' END").alias("data_format"),
        E("concat('tenant', user_id % 7)").alias("tenant_id"),
        F.col("event_type").alias("dataset_id"),
        F.col("ts"),
        data.alias("data"),
        E("CASE event_id % 4 WHEN 0 THEN 'ndjson' WHEN 1 THEN 'text' WHEN 2 THEN 'csv' ELSE 'apache' END").alias("data_hint"),
        E("concat('10.0.', user_id % 4, '.', user_id % 250)").alias("source_ip"),
    )


def doc_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as message payloads (multi-line prose)."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return d.select(
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("dataset_id"),
        F.col("text").alias("data"),
    )


def syslog_messages(spark: SparkSession, sf: str) -> DataFrame:
    """RFC5424 (with/without structured data), RFC3164 and plain lines."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    pri = E("cast(event_id % 192 as string)")
    host = E("concat('host', user_id % 10)")
    ts5424 = E("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    ts3164 = E("concat(date_format(ts, 'MMM'), ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'))")
    body = E("concat('user ', user_id, ' did ', event_type)")
    line = (
        F.when(E("event_id % 4 = 0"), F.concat(F.lit("<"), pri, F.lit(">1 "), ts5424, F.lit(" "), host, F.lit(" "),
                                               F.col("event_type"), F.lit(" "), E("cast(user_id as string)"),
                                               F.lit(" ID"), E("cast(event_id % 50 as string)"),
                                               F.lit(' [ex@32473 iut="3"] '), body))
        .when(E("event_id % 4 = 1"), F.concat(F.lit("<"), pri, F.lit(">1 "), ts5424, F.lit(" "), host, F.lit(" "),
                                              F.col("event_type"), F.lit(" - - - "), body))
        .when(E("event_id % 4 = 2"), F.concat(F.lit("<"), pri, F.lit(">"), ts3164, F.lit(" "), host, F.lit(" "),
                                              F.col("event_type"), F.lit("["), E("cast(user_id as string)"),
                                              F.lit("]: "), body))
        .otherwise(F.concat(F.lit("plain "), body))
    )
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        E("concat('10.0.', user_id % 4, '.', user_id % 250)").alias("source_ip"),
        line.alias("data"),
    )


def kafka_records(spark: SparkSession, sf: str) -> DataFrame:
    """Kafka-shaped records: key, value, topic, partition, offset, headers."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props")
    return (
        e.select(
            "event_id",
            E("CASE WHEN user_id % 10 = 0 THEN '' ELSE cast(user_id as string) END").alias("key"),
            F.col("props").alias("value"),
            F.col("event_type").alias("topic"),
            E("cast(user_id % 4 as int)").alias("partition"),
            F.col("ts").alias("timestamp"),
            E("array(named_struct('key', 'trace', 'value', concat('t', event_id)), "
              "named_struct('key', 'src', 'value', concat('u', user_id)))").alias("headers"),
        )
        .withColumn("_one", F.lit(1))
        # offset = rows before this one in its (topic, partition): a two-level
        # running count, so a busy partition is not sorted in one task
        .transform(lambda d: exclusive_running_sum(d, "_one", ["topic", "partition"], ["event_id"], "offset"))
        .drop("_one")
    )


def spool_files(spark: SparkSession, sf: str) -> DataFrame:
    """Spool-file metadata rows: one batch file per order."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
              "o_orderdate", "o_orderpriority")
    base = o.select(
        F.col("o_orderkey").alias("okey"),
        E("concat('tenant', o_custkey % 11)").alias("tenant_id"),
        E("concat('ds', substring(o_orderpriority, 1, 1))").alias("dataset_id"),
        E("CASE o_orderkey % 3 WHEN 0 THEN 'ndjson' WHEN 1 THEN 'raw' ELSE 'csv' END").alias("data_hint"),
        E("CASE o_orderstatus WHEN 'O' THEN 'queue' WHEN 'F' THEN 'dlq' ELSE 'retry' END").alias("state"),
        E("CASE WHEN o_orderkey % 50 = 0 THEN 'success' WHEN o_orderstatus = 'O' THEN 'pending' "
          "WHEN o_orderstatus = 'F' THEN 'dlq' ELSE 'retry' END").alias("status"),
        E("cast(round(o_totalprice) as bigint)").alias("size"),
        E("cast(o_orderdate as timestamp_ntz)").alias("created_at"),
        E("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey)").alias("mod_time"),
        E("cast(o_orderkey % 7 as int)").alias("retry_count"),
        E("cast(o_orderkey % 1000 + 1 as int)").alias("line_count"),
        E("concat('tok', o_custkey % 3)").alias("bearer_token"),
        E("CASE o_orderkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'size_limit_reached' "
          "WHEN 2 THEN 'service_shutdown' ELSE 'line_limit_reached' END").alias("trigger_reason"),
        E("CASE o_orderstatus WHEN 'F' THEN 'Exceeded retry limit' WHEN 'P' THEN 'HTTP 503' ELSE '' END").alias("failure_reason"),
    )
    return base.select(
        E("concat(tenant_id, '--', dataset_id, '--', okey, '--', data_hint)").alias("id"),
        "okey", "tenant_id", "dataset_id", "data_hint", "state", "status", "size",
        "created_at", "mod_time", "retry_count", "line_count", "bearer_token",
        "trigger_reason", "failure_reason",
        E("concat(tenant_id, '/', dataset_id, '/', state, '/', tenant_id, '--', dataset_id, '--', okey, '--', data_hint, '.gz')").alias("path"),
    )


# Status code per l_quantity band (quantity 1..50, taken mod 10).
ATTEMPT_STATUS_SQL = (
    "CASE cast(l_quantity as int) % 10 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 400 "
    "WHEN 3 THEN 401 WHEN 4 THEN 404 WHEN 5 THEN 413 WHEN 6 THEN 429 WHEN 7 THEN 500 "
    "WHEN 8 THEN 503 ELSE NULL END"
)


ATTEMPT_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery attempts: one per line item of the order whose file it is."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_extendedprice", "l_shipdate")
    # Attempts are numbered chronologically per file (line numbers repeat).
    w = Window.partitionBy("l_orderkey").orderBy(*ATTEMPT_ORDER)
    return li.select(
        F.col("l_orderkey").alias("okey"),
        F.row_number().over(w).alias("attempt_no"),
        E(ATTEMPT_STATUS_SQL).cast("int").alias("status_code"),
        F.col("l_shipdate").alias("ts"),
    )


def raw_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw landing files: key, order key and size, for batch packing."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
               "l_linestatus", "l_extendedprice", "l_shipdate")
    return li.select(
        E("concat('t', l_suppkey % 10)").alias("tenant_id"),
        F.col("l_returnflag").alias("dataset_id"),
        E("CASE l_linestatus WHEN 'O' THEN 'ndjson' ELSE 'raw' END").alias("data_hint"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("lno"),
        F.col("l_partkey").alias("pkey"),
        F.col("l_suppkey").alias("skey"),
        E("cast(round(l_extendedprice) as bigint)").alias("size"),
        E("(l_orderkey + l_linenumber) % 2 = 0").alias("ends_nl"),
    )


SEGMENT_SOURCE_SQL = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'udp' WHEN 'BUILDING' THEN 'syslog' "
    "WHEN 'FURNITURE' THEN 'http' WHEN 'MACHINERY' THEN 'kafka' ELSE '' END"
)


def control_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Nested control documents: one tenant per nation, its customers as
    datasets (paged: one row per tenant and page of up to 64 datasets)."""
    n = table(spark, sf, "nation", "n_nationkey", "n_name")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    ds = c.select(
        F.col("c_nationkey").alias("nk"),
        F.struct(
            E("concat('ds', c_custkey)").alias("dataset_id"),
            E("concat('Set ', c_custkey)").alias("name"),
            E("c_custkey % 4 <> 0").alias("active"),
            F.struct(
                F.struct(
                    E(SEGMENT_SOURCE_SQL).alias("type"),
                    E("CASE WHEN c_custkey % 13 = 0 THEN map('port', cast(1024 + c_custkey % 600 as string), "
                      "'tenant_id', concat('override', c_custkey)) "
                      "ELSE map('port', cast(1024 + c_custkey % 600 as string)) END").alias("custom"),
                ).alias("source"),
            ).alias("config"),
            F.col("c_custkey").alias("pos"),
        ).alias("ds"),
        # A tenant's datasets are paged (at most 64 per document row) so no
        # row ever nests an unbounded group.
        E("c_custkey div 64").alias("page"),
    ).groupBy("nk", "page").agg(F.collect_list("ds").alias("datasets"))
    return n.join(ds, n.n_nationkey == ds.nk, "left").select(
        E("concat('tenant', n_nationkey)").alias("tenant_id"),
        F.col("n_name").alias("tenant_name"),
        E("n_nationkey % 5 <> 0").alias("active"),
        F.coalesce("page", F.lit(0).cast("long")).alias("page"),
        F.coalesce("datasets", E("array()").cast(ds.schema["datasets"].dataType)).alias("datasets"),
    )


def receivers(spark: SparkSession, sf: str) -> DataFrame:
    """Receiver endpoints with payload limits (one zero / non-positive)."""
    s = table(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    return s.select(
        F.col("s_suppkey").alias("pos"),
        E("concat('host', s_suppkey, ':', 8000 + s_suppkey % 5)").alias("instance_api"),
        E("CASE WHEN s_suppkey = 0 THEN 0 ELSE cast(round(s_acctbal * 1000) as bigint) END").alias("max_payload_size"),
    )


def port_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Per-port cumulative drop counters, reset to zero on one day (a
    running count)."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    d = e.select(
        "event_id", "ts", E("cast(1000 + user_id % 6 as int)").alias("port"),
        E("CASE WHEN event_type = 'error' THEN 1 ELSE 0 END").alias("is_err"),
    )
    d = running_sum(d, "is_err", ["port"], ["ts", "event_id"], "_n")
    return d.select(
        "event_id", "ts", "port",
        F.when(E("to_date(ts) = date'2024-01-15'"), F.lit(0).cast("long")).otherwise(F.col("_n")).alias("drops"),
    )


def host_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative CPU tick counters per host (running sums)."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    v = E("cast(round(value) as bigint)")
    d = e.select(
        "event_id", "ts", E("concat('host', user_id % 5)").alias("host"),
        F.when(E("event_type IN ('click', 'view')"), v).otherwise(0).alias("u"),
        F.when(E("event_type = 'error'"), v).otherwise(0).alias("s"),
        F.when(E("event_type = 'purchase'"), 3).otherwise(0).alias("io"),
        F.lit(10).alias("tick"),
    )
    names = {"user": "u", "system": "s", "idle": "tick", "iowait": "io"}
    d = running_sums(d, {out: F.col(src) for out, src in names.items()}, ["host"], ["ts", "event_id"])
    return d.select("event_id", "ts", "host", "user", "system", "idle", "iowait")


POLL_STATUS_SQL = (
    "CASE event_type WHEN 'click' THEN 200 WHEN 'error' THEN 401 WHEN 'signup' THEN 403 "
    "WHEN 'view' THEN 404 ELSE 500 END"
)


def poll_log(spark: SparkSession, sf: str) -> DataFrame:
    """Control-plane poll outcomes per instance."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props")
    return e.select(
        "event_id", "ts", E("concat('inst', user_id % 8)").alias("instance"),
        E(POLL_STATUS_SQL).cast("int").alias("status"),
        F.col("props").alias("config"),
    )


def error_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Error reports and resolve events (``signup`` rows resolve)."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    return e.select(
        "event_id", "ts",
        E("CASE WHEN event_type = 'signup' THEN 'resolve' ELSE 'report' END").alias("kind"),
        E("concat('type', user_id % 3)").alias("error_type"),
        E("concat('ds', user_id % 5)").alias("dataset_id"),
        E("concat('tenant', user_id % 7)").alias("tenant_id"),
        E("CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END").alias("severity"),
        E("concat(event_type, ' from user ', user_id)").alias("message"),
    )


def tenants(spark: SparkSession, sf: str) -> DataFrame:
    """Tenant status lookups, one per nation; tenant10 is skipped (missing)."""
    n = table(spark, sf, "nation", "n_nationkey")
    return n.select(
        E("concat('tenant', n_nationkey + CASE WHEN n_nationkey >= 10 THEN 1 ELSE 0 END)").alias("tenant_id"),
        E("CASE WHEN n_nationkey = 5 THEN 404 WHEN n_nationkey = 6 THEN 500 ELSE 200 END").cast("int").alias("status_code"),
        E("CASE WHEN n_nationkey = 5 OR n_nationkey = 6 THEN NULL ELSE n_nationkey % 4 <> 3 END").alias("active"),
    )


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry payloads: compact object, text, pretty-printed object, array,
    ``null``, a padded object, blanks."""
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    pretty = E("concat('{', '\\n', '  \"k\": ', user_id, ',', '\\n', '  \"t\": \"', event_type, "
               "' \\\\\"x\\\\\" y\",', '\\n', '  \"n\": [1, 2]', '\\n', '}')")
    data = (
        F.when(E("event_id % 4 = 0"), F.col("props"))
        .when(E("event_id % 4 = 1"), E("concat('user ', user_id, ' ', event_type)"))
        .when(E("event_id % 4 = 2"), pretty)
        .when(E("event_id % 20 = 3"), F.lit(" null "))
        .when(E("event_id % 20 = 7"), E("concat('\\0', props, ' ')"))
        .when(E("event_id % 20 = 11"), F.lit("   "))
        .otherwise(E("concat('[', user_id, ', 2]')"))
    )
    return e.select("event_id", data.alias("data"))


def spool_listing(spark: SparkSession, sf: str) -> DataFrame:
    """File listing of the spool: data files (some missing) and ``.meta`` files.

    Same shape as a ``binaryFile`` scan with content pruned:
    ``(path, length, modificationTime)``.
    """
    f = spool_files(spark, sf)
    data = f.where("okey % 13 <> 0").select(
        "path", F.col("size").alias("length"), F.col("mod_time").alias("modificationTime"))
    meta = f.where("state IN ('retry', 'dlq')").select(
        E("concat(tenant_id, '/', dataset_id, '/', state, '/', id, '.meta')").alias("path"),
        E("200 + okey % 50").cast("long").alias("length"),
        F.col("mod_time").alias("modificationTime"))
    return data.unionByName(meta)


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """Instances: receiver URL and configured batch max bytes."""
    n = table(spark, sf, "nation", "n_nationkey")
    return n.select(
        E("concat('inst', n_nationkey)").alias("instance"),
        E("concat('http://host', n_nationkey * 4, ':', 8000 + n_nationkey % 7, '/')").alias("receiver_url"),
        E("CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5000000 ELSE 50000000 END").cast("long").alias("max_bytes"),
    )


def local_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Locally configured inputs (position, type, name, config map)."""
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    cfg = E(
        "map_concat(map('dataset_id', CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'Admin' "
        "ELSE concat('ds', c_custkey % 400) END, "
        "'port', CASE WHEN c_custkey % 23 = 0 THEN 'x' WHEN c_custkey % 29 = 0 THEN '70000' "
        "ELSE cast(1024 + c_custkey % 700 as string) END), "
        "CASE WHEN c_custkey % 3 = 0 THEN map('tenant_id', concat('tenant', c_custkey % 5)) ELSE map() END, "
        "CASE WHEN c_custkey % 4 = 0 THEN map('bearer_token', concat('tok', c_custkey)) ELSE map() END, "
        "CASE WHEN c_custkey % 11 = 0 THEN map('buffer_size', cast(c_custkey * 7 as string)) ELSE map() END)"
    )
    return c.select(
        F.col("c_custkey").alias("pos"),
        E(SEGMENT_SOURCE_SQL).alias("type"),
        E("concat('in', c_custkey)").alias("name"),
        cfg.alias("config"),
    )


def port_maps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old and new port -> plugin assignments in order of ``pos`` (drops,
    renames, additions; ports repeat)."""
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    typ = E(SEGMENT_SOURCE_SQL)
    old = c.select(F.col("c_custkey").alias("pos"), E("cast(1024 + c_custkey % 900 as int)").alias("port"),
                   F.concat(typ, F.lit("[ds"), F.col("c_custkey").cast("string"), F.lit("]")).alias("plugin"))
    kept = c.where("c_custkey % 9 <> 0").select(
        F.col("c_custkey").alias("pos"), E("cast(1024 + c_custkey % 950 as int)").alias("port"),
        F.concat(typ, F.lit("[ds"), F.col("c_custkey").cast("string"),
                 F.when(E("c_custkey % 7 = 0"), F.lit("-v2")).otherwise(F.lit("")), F.lit("]")).alias("plugin"))
    added = c.where("c_custkey % 5 = 0").select(
        F.col("c_custkey").alias("pos"), E("cast(20000 + c_custkey as int)").alias("port"),
        F.concat(typ, F.lit("[extra"), F.col("c_custkey").cast("string"), F.lit("]")).alias("plugin"))
    return old, kept.unionByName(added)


def nats_records(spark: SparkSession, sf: str) -> DataFrame:
    """NATS-shaped records: subject, optional reply, data, multi-value headers."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props")
    return e.select(
        F.col("event_id").alias("seq"), E("concat('events.', event_type)").alias("subject"),
        E("CASE WHEN event_id % 3 = 0 THEN concat('inbox.', user_id) ELSE '' END").alias("reply"),
        F.col("props").alias("data"), "ts",
        E("map('Trace', array(concat('t', event_id), 'x'), 'Empty', cast(array() as array<string>))").alias("headers"))


def sqs_records(spark: SparkSession, sf: str) -> DataFrame:
    """SQS-shaped messages from documents (some bodies NULL)."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select(
        F.col("doc_id").alias("seq"), E("concat('m', doc_id)").alias("message_id"),
        E("CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END").alias("body"),
        E("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("ts"))


def kinesis_records(spark: SparkSession, sf: str) -> DataFrame:
    """Kinesis-shaped records: shard and sequence number."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "props")
    return e.select(E("concat('shard-', user_id % 4)").alias("shard_id"), F.col("event_id").alias("sequence_number"),
                    F.col("props").alias("data"), "ts")


def http_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Webhook requests from pages: method, headers, declared length, body."""
    p = table(spark, sf, "pages", "page_id", "url", "html")
    return p.select(
        F.col("page_id").alias("seq"),
        E("CASE WHEN page_id % 6 = 5 THEN 'GET' ELSE 'POST' END").alias("method"),
        F.lit("/ingest").alias("path"),
        E("map(CASE WHEN page_id % 3 = 0 THEN 'authorization' ELSE 'Authorization' END, CASE WHEN page_id % 7 = 3 THEN 'Bearer bad' ELSE 'Bearer secret' END, "
          "CASE WHEN page_id % 4 = 0 THEN 'CONTENT-TYPE' ELSE 'Content-Type' END, 'text/html', 'User-Agent', concat('ua/', page_id % 3), "
          "CASE WHEN page_id % 2 = 0 THEN 'X-Request-Id' ELSE 'x-request-id' END, concat('r', page_id), 'X-Source', url)")
        .alias("headers"),
        E("CASE WHEN page_id % 11 = 0 THEN 100 ELSE octet_length(html) END").cast("long").alias("declared_length"),
        F.col("html").alias("body"),
        E("concat('10.1.0.', page_id % 250)").alias("remote_addr"),
        E("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id)").alias("ts"))


def multipart_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Multipart socket messages from pages (topic + payload frames)."""
    p = table(spark, sf, "pages", "page_id", "url", "html")
    return p.select(
        F.col("page_id").alias("seq"),
        E("CASE page_id % 3 WHEN 1 THEN 'PULL' ELSE 'SUB' END").alias("socket_type"),
        E("CASE WHEN page_id % 2 = 0 THEN array(url, html) ELSE array(html) END").alias("parts"))


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Raw-file names ``{nanos}_{bytes}_{lines}.{ext}`` (with odd variants)
    and the line count actually found in each file."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
               "l_shipdate")
    n = E("concat(cast(unix_micros(cast(l_shipdate as timestamp)) * 1000 + l_partkey as string), '_', "
          "cast(round(l_extendedprice) as bigint), '_', "
          "CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE cast(cast(l_quantity as int) as string) END)")
    name = (F.when(E("l_linenumber % 6 = 0"), F.concat(n, F.lit(".ndjson")))
            .when(E("l_linenumber % 6 = 1"), F.concat(n, F.lit(".log")))
            .when(E("l_linenumber % 6 = 2"), F.concat(n, F.lit(".csv")))
            .when(E("l_linenumber % 6 = 3"), F.concat(n, F.lit(".txt")))
            .when(E("l_linenumber % 6 = 4"), n)
            .otherwise(E("concat('old_', l_orderkey, '.xml')")))
    return li.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("lno"),
                     F.col("l_partkey").alias("pkey"), name.alias("name"),
                     E("cast(l_quantity as int) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END").alias("actual_lines"))


def _hx(expr: str, width: int = 2) -> str:
    return f"lpad(hex({expr}), {width}, '0')"


def _ip_header_sql(first: str) -> str:
    return ("concat(CASE WHEN l_suppkey % 2 = 0 THEN '45' ELSE '46' END, '0000540000400040', "
            "CASE l_partkey % 3 WHEN 0 THEN '06' WHEN 1 THEN '11' ELSE '01' END, '0000', "
            f"{first}, {_hx('l_partkey % 256')}, {_hx('l_suppkey % 256')}, {_hx('l_linenumber')}, "
            f"'C0A8', {_hx('l_orderkey % 256')}, {_hx('l_partkey % 200')}, "
            "CASE WHEN l_suppkey % 2 = 1 THEN '01010101' ELSE '' END, "
            f"{_hx('CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_partkey % 65536 END', 4)}, {_hx('(l_suppkey * 7) % 65536', 4)})")


SFLOW_HEADER_SQL = (
    "CASE (l_partkey div 3) % 4 "
    f"WHEN 0 THEN concat('AABBCCDDEEFF1122334455660800', {_ip_header_sql(chr(39) + '0A' + chr(39))}) "
    f"WHEN 1 THEN {_ip_header_sql(chr(39) + '45' + chr(39))} "
    "WHEN 2 THEN concat('AABBCCDDEEFF11223344556686DD60000000', repeat('00', 36)) "
    f"ELSE substring(concat('AABBCCDDEEFF1122334455660800', {_ip_header_sql(chr(39) + '0A' + chr(39))}), 1, 38) END"
)


def flow_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded sFlow packets: one per order, one sample with the order's
    line items as flow records (header / IPv4 / IPv6 / other)."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice")
    rec = F.struct(
        F.col("l_linenumber").alias("lno"), F.col("l_partkey").alias("pkey"), F.col("l_suppkey").alias("skey"),
        F.col("l_quantity").alias("qty"),
        E("CASE l_linenumber % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'ipv4' WHEN 2 THEN 'ipv6' ELSE 'other' END").alias("kind"),
        E("CASE WHEN l_linenumber % 4 = 0 THEN 1 WHEN l_linenumber % 4 = 1 THEN 6 WHEN l_linenumber % 4 = 2 THEN 17 END")
        .cast("int").alias("protocol"),
        E("64 + l_linenumber").cast("int").alias("frame_length"),
        F.unhex(E(SFLOW_HEADER_SQL)).alias("header"),
        F.unhex(E(f"CASE l_linenumber % 4 WHEN 1 THEN concat('AC10', {_hx('l_partkey % 256')}, {_hx('l_suppkey % 256')}) "
                  f"WHEN 2 THEN concat('20010DB8', repeat('0', 20), {_hx('l_partkey % 65536', 4)}) END")).alias("src_ip"),
        F.unhex(E(f"CASE l_linenumber % 4 WHEN 1 THEN concat('AC11', {_hx('l_orderkey % 256')}, {_hx('l_linenumber')}) "
                  "WHEN 2 THEN concat('20010DB8', repeat('0', 23), '1') END")).alias("dst_ip"),
        E("CASE WHEN l_linenumber % 4 IN (1, 2) THEN cast(l_partkey % 65536 as int) END").alias("src_port"),
        E("CASE WHEN l_linenumber % 4 IN (1, 2) THEN 443 END").cast("int").alias("dst_port"),
    )
    # At most a handful of line items per order: a bounded group.
    recs = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(rec)).alias("records"))
    j = o.join(recs, o.o_orderkey == recs.l_orderkey, "left")
    sample = F.struct(
        E("CASE WHEN o_orderkey % 5 = 0 THEN 'expanded' ELSE 'flow' END").alias("kind"),
        E("cast(100 + o_orderkey % 7 as int)").alias("sampling_rate"),
        E("cast(o_orderkey % 48 as int)").alias("input_if"),
        E("cast(o_custkey % 48 as int)").alias("output_if"),
        F.coalesce("records", F.array().cast(recs.schema["records"].dataType)).alias("records"))
    # Agents send interface counters too; they carry records that are no flows.
    counter = sample.withField("kind", F.lit("counter"))
    return j.select(
        F.col("o_orderkey").alias("packet_id"), F.lit(5).alias("version"),
        F.unhex(E(f"concat('0A', {_hx('o_custkey % 256')}, {_hx('o_orderkey % 256')}, '01')")).alias("agent_ip"),
        F.col("o_orderkey").alias("sequence_number"),
        F.when(E("o_orderkey % 11 = 0"), F.slice(F.array(sample), 1, 0))
        .when(E("o_orderkey % 3 = 0"), F.array(counter, sample)).otherwise(F.array(sample)).alias("samples"))


def ipfix_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded IPFIX packets: one per order, one flow message per line item;
    every ninth packet is template-only (no flows)."""
    o = table(spark, sf, "orders", "o_orderkey")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_shipdate")
    flow = F.struct(
        F.col("l_linenumber").alias("_lno"), F.col("l_partkey").alias("_pkey"), F.col("l_suppkey").alias("_skey"),
        F.lit("IPFIX").alias("Type"),
        E("unix_micros(cast(l_shipdate as timestamp)) * 1000").alias("TimeReceivedNs"),
        E("cast(l_linenumber as long)").alias("SequenceNum"),
        E("CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 100 END").cast("long").alias("SamplingRate"),
        F.unhex(F.lit("0A000001")).alias("SamplerAddress"),
        F.unhex(E(f"CASE l_linenumber % 3 WHEN 0 THEN concat('0A00', {_hx('l_partkey % 256')}, {_hx('l_suppkey % 256')}) "
                  f"WHEN 1 THEN concat('20010DB8', repeat('0', 20), {_hx('l_partkey % 65536', 4)}) ELSE '' END")).alias("SrcAddr"),
        F.unhex(E(f"concat('C0A8', {_hx('l_orderkey % 256')}, '01')")).alias("DstAddr"),
        E("cast(round(l_extendedprice) as long)").alias("Bytes"),
        E("cast(l_quantity as long)").alias("Packets"),
        E("CASE WHEN l_linenumber % 3 = 1 THEN 34525 ELSE 2048 END").cast("long").alias("Etype"),
        E("CASE l_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 0 END").cast("long").alias("Proto"),
        E("CASE WHEN l_partkey % 3 = 2 THEN 0 ELSE l_partkey % 65536 END").cast("long").alias("SrcPort"),
        E("CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 443 END").cast("long").alias("DstPort"),
        E("l_orderkey % 10").cast("long").alias("InIf"),
        F.lit(0).cast("long").alias("OutIf"),
        E("(l_suppkey % 3) * 64512").cast("long").alias("SrcAs"),
        F.lit(0).cast("long").alias("DstAs"),
        F.unhex(E("CASE WHEN l_partkey % 4 = 0 THEN '' ELSE '0A0000FE' END")).alias("NextHop"),
        E("CASE WHEN l_suppkey % 2 = 0 THEN cast(array() as array<long>) ELSE array(cast(l_suppkey as long)) END").alias("BgpCommunities"),
        E("CASE WHEN l_partkey % 5 = 0 THEN cast(array() as array<long>) ELSE array(64512L, 65000L) END").alias("AsPath"),
        E("CASE WHEN l_linenumber = 1 THEN 64 ELSE 0 END").cast("long").alias("ForwardingStatus"),
    )
    flows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(flow)).alias("flows"))
    j = o.join(flows, o.o_orderkey == flows.l_orderkey, "left")
    return j.select(F.col("o_orderkey").alias("packet_id"),
                    F.when(E("o_orderkey % 9 = 0") | F.col("flows").isNull(),
                           F.expr("filter(flows, x -> false)")).otherwise(F.col("flows")).alias("flows"))


def netflow_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded NetFlow v9 packets: header fields and one data flow set of
    the order's line items."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    recs = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("InIf"), F.col("l_partkey").alias("SrcPort"),
                                             F.col("l_quantity").cast("long").alias("Packets")))).alias("records"))
    j = o.join(recs, o.o_orderkey == recs.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").alias("packet_id"), F.lit(9).alias("Version"),
        F.coalesce(F.size("records"), F.lit(0)).alias("Count"),
        (F.col("o_orderkey") * 1000).alias("SystemUptime"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("UnixSeconds"),
        F.col("o_orderkey").alias("SequenceNumber"), (F.col("o_custkey") % 16).alias("SourceId"),
        F.when(F.col("records").isNull(), F.array().cast("array<struct<Id:int,Records:array<struct<InIf:int,SrcPort:bigint,Packets:bigint>>>>"))
        .otherwise(F.array(F.struct(F.lit(256).alias("Id"), F.col("records").alias("Records")))).alias("FlowSets"))


def _u(expr: str, size: int) -> str:
    """SQL: a number as ``size`` bytes in hex."""
    return f"lpad(hex({expr}), {2 * size}, '0')"


# Two layouts of the 16 bytes that the datagrams' records share.
WIRE_LAYOUTS = ("00080004000C000400070002000B000200010004", "000C0004000800040001000400070002000B0002")


def datagrams(spark: SparkSession, sf: str) -> DataFrame:
    """NetFlow v9 and IPFIX datagrams: one per document with an id, exported
    by its source, with up to 23 records. Every seventh (by id) announces one
    of two layouts, every twenty-first a sampling rate; some are cut short or
    of an older version."""
    d = table(spark, sf, "documents", "doc_id", "source", "n_chars").where("doc_id IS NOT NULL").select(
        "doc_id", F.unhex(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 8)).alias("exporter"),
        F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"), E("doc_id % 2 = 0").alias("v9"), E("doc_id % 7 = 0").alias("tells"),
        E("doc_id % 21 = 0").alias("samples"))
    name = "if(v9, '', concat('04', hex(concat('eth', cast(r % 10 as string)))))"
    record = (f"concat({_u('167772160 + (doc_id * 31 + r) % 16777216', 4)}, {_u('3232235520 + (doc_id + r * 7) % 65536', 4)}, "
              f"{_u('(doc_id * 13 + r) % 65536', 2)}, '01BB', {_u('(n * 97 + r * 1500) % 2147483648', 4)}, {name})")
    d = d.withColumn("flows", E(f"array_join(transform(sequence(1, 1 + n % 23), r -> {record}), '')"))

    def sent(set_id: str, body: str) -> str:
        return f"concat({_u(set_id, 2)}, {_u(f'4 + length({body}) div 2', 2)}, {body})"

    layout = f"concat('012C', if(v9, '0005', '0006'), if(doc_id div 7 % 2 = 0, '{WIRE_LAYOUTS[0]}', '{WIRE_LAYOUTS[1]}'), if(v9, '', '0052FFFF'))"
    option = "concat('012D', if(v9, '0004000400010004', '0002000100820004'), '00220004', '0000')"
    rate = f"concat('0A000001', {_u('100 + doc_id % 900', 4)})"
    d = d.withColumn("sets", E(f"""concat(if(tells, {sent("if(v9, 0, 2)", layout)}, ''),
        if(samples, concat({sent("if(v9, 1, 3)", option)}, {sent("301", rate)}), ''), {sent("300", "flows")})"""))
    count = "1 + n % 23 + cast(tells as int) + 2 * cast(samples as int)"
    head = (f"if(v9, concat('0009', {_u(count, 2)}, {_u('doc_id % 100000', 4)}, {_u('1600000000 + doc_id', 4)}), "
            f"concat('000A', {_u('16 + length(sets) div 2', 2)}, {_u('1600000000 + doc_id', 4)}))")
    whole = f"concat(if(doc_id % 89 = 3, '0005', substring({head}, 1, 4)), substring({head}, 5), {_u('doc_id', 4)}, {_u('doc_id div 2 % 3', 4)}, sets)"
    payload = F.unhex(E(whole))
    return d.select(F.col("doc_id").alias("packet_id"), "exporter", F.col("doc_id").alias("received"),
                    F.when(E("doc_id % 97 = 5"), F.substring(payload, F.lit(1), F.octet_length(payload) - 3)).otherwise(payload).alias("payload"))
