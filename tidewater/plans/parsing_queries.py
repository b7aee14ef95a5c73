"""Queries for syslog and flow parsing (PAR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.syslog import RFC3164, RFC5424
from ..operators import parsing
from ..sources import fixtures as fx
from .catalog import register
from .oracle_fixtures import with_fixtures

P5, P3 = RFC5424.removeprefix("(?d)"), RFC3164.removeprefix("(?d)")

_SYSLOG_ORACLE = with_fixtures(f"""
SELECT seq,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 1) WHEN m3 THEN regexp_extract(d, '{P3}', 1) END AS priority,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 2) END AS version,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 3) WHEN m3 THEN regexp_extract(d, '{P3}', 2) END AS syslog_timestamp,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 4) WHEN m3 THEN regexp_extract(d, '{P3}', 3) END AS hostname,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 5) END AS app_name,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 6) END AS proc_id,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 7) END AS msg_id,
  CASE WHEN m3 THEN regexp_extract(d, '{P3}', 4) END AS tag,
  CASE WHEN m5 THEN regexp_extract(d, '{P5}', 8) WHEN m3 THEN regexp_extract(d, '{P3}', 5) ELSE d END AS message,
  CASE WHEN m5 THEN '5424' WHEN m3 THEN '3164' ELSE 'raw' END AS rfc,
  source_ip, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM (SELECT *, trim(data) AS d, regexp_matches(trim(data), '{P5}') AS m5,
             NOT regexp_matches(trim(data), '{P5}') AND regexp_matches(trim(data), '{P3}') AS m3
      FROM syslog_messages)""")


@register("par03_syslog", _SYSLOG_ORACLE)
def q_syslog(spark, sf):
    """PAR-01..03: auto-mode syslog parsing, fields read back from the NDJSON."""
    p = parsing.parse_syslog_messages(fx.syslog_messages(spark, sf))
    fields = ("priority", "version", "syslog_timestamp", "hostname", "app_name", "proc_id",
              "msg_id", "tag", "message", "rfc", "source_ip", "timestamp")
    schema = ", ".join(f"{f} string" for f in fields)
    return p.select("seq", F.from_json("ndjson", schema).alias("j")).select("seq", *[F.col(f"j.{f}") for f in fields])


@register("par01_rfc5424_only", with_fixtures(f"""
SELECT seq, CASE WHEN regexp_matches(trim(data), '{P5}') THEN '5424' ELSE 'raw' END AS rfc,
  CASE WHEN regexp_matches(trim(data), '{P5}') THEN regexp_extract(trim(data), '{P5}', 8) ELSE trim(data) END AS message
FROM syslog_messages"""))
def q_rfc5424_only(spark, sf):
    """PAR-01 with mode rfc5424: RFC3164 lines fall back to raw."""
    p = parsing.parse_syslog_messages(fx.syslog_messages(spark, sf), mode="rfc5424")
    return p.select("seq", F.col("parsed.rfc").alias("rfc"), F.col("parsed.message").alias("message"))


@register("par02_rfc3164_only", with_fixtures(f"""
SELECT seq, CASE WHEN regexp_matches(trim(data), '{P3}') THEN '3164' ELSE 'raw' END AS rfc,
  CASE WHEN regexp_matches(trim(data), '{P3}') THEN regexp_extract(trim(data), '{P3}', 4) END AS tag
FROM syslog_messages"""))
def q_rfc3164_only(spark, sf):
    """PAR-02 with mode rfc3164."""
    p = parsing.parse_syslog_messages(fx.syslog_messages(spark, sf), mode="rfc3164")
    return p.select("seq", F.col("parsed.rfc").alias("rfc"), F.col("parsed.tag").alias("tag"))
