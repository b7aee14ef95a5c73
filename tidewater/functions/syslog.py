"""Syslog line parsing (RFC5424 / RFC3164 / raw fallback), regex only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rfc3339

# The two syslog line patterns. `(?d)` makes `.` stop only at
# `\n` (as in RE2/Go) instead of every Unicode line terminator.
RFC5424 = r"(?d)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[.*?\]\s+)?(.*)$"
RFC3164 = r"(?d)^<(\d+)>(\w{3}\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?):\s*(.*)$"

FIELDS = ("priority", "version", "syslog_timestamp", "hostname", "app_name", "proc_id", "msg_id", "tag", "message", "rfc")


def with_syslog(df: DataFrame, line: str, out: str = "parsed", mode: str = "auto") -> DataFrame:
    """PAR-01..03: parse the trimmed syslog lines of a column into a struct.

    ``mode`` is ``auto`` (5424 first, then 3164), ``rfc5424`` or ``rfc3164``;
    unmatched lines become ``rfc = 'raw'`` with the whole line as message.
    Absent fields are NULL (dropped by ``to_json``).

    Each pattern runs once a line: a replacement puts its groups on lines of
    their own. No group can hold a newline but the RFC3164 time, which goes
    last. A match turns the leading ``<`` into digits.
    """
    l = F.col(line)
    tagged = l.startswith("<")
    d = df
    if mode in ("auto", "rfc5424"):
        d = d.withColumn("_s5", F.when(tagged, F.regexp_replace(l, RFC5424, "$1\n$2\n$3\n$4\n$5\n$6\n$7\n$8")))
    else:
        d = d.withColumn("_s5", F.lit(None).cast("string"))
    d = d.withColumn("_a5", F.when(~F.col("_s5").startswith("<"), F.split("_s5", "\n", 8)))
    if mode in ("auto", "rfc3164"):
        d = d.withColumn("_s3", F.when(tagged & F.col("_a5").isNull(), F.regexp_replace(l, RFC3164, "$1\n$3\n$4\n$5\n$2")))
    else:
        d = d.withColumn("_s3", F.lit(None).cast("string"))
    d = d.withColumn("_a3", F.when(~F.col("_s3").startswith("<"), F.split("_s3", "\n", 5)))
    a5, a3 = F.col("_a5"), F.col("_a3")
    five, three = a5.isNotNull(), a3.isNotNull()
    parsed = F.struct(
        F.coalesce(a5[0], a3[0]).alias("priority"), a5[1].alias("version"), F.coalesce(a5[2], a3[4]).alias("syslog_timestamp"),
        F.coalesce(a5[3], a3[1]).alias("hostname"), a5[4].alias("app_name"), a5[5].alias("proc_id"), a5[6].alias("msg_id"),
        a3[2].alias("tag"), F.when(five, a5[7]).when(three, a3[3]).otherwise(l).alias("message"),
        F.when(five, F.lit("5424")).when(three, F.lit("3164")).otherwise(F.lit("raw")).alias("rfc"))
    return d.withColumn(out, parsed).drop("_s5", "_a5", "_s3", "_a3")


def syslog_json(parsed: str, source_ip: str, ingest_ts: str) -> Column:
    """PAR-03: the NDJSON record of a parsed line (source_ip, timestamp, fields)."""
    return F.to_json(F.struct(F.col(source_ip).alias("source_ip"), rfc3339(ingest_ts).alias("timestamp"),
                              *[F.col(f"{parsed}.{f}").alias(f) for f in FIELDS]))
