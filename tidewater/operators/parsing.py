"""Parsing operators: syslog lines and decoded flow records to NDJSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import syslog as S
from ..functions import text as T


def parse_syslog_messages(df: DataFrame, data: str = "data", source_ip: str = "source_ip",
                          ts: str = "ts", mode: str = "auto") -> DataFrame:
    """PAR-03: trim (NUL, whitespace), drop empty, parse, render NDJSON."""
    p = df.withColumn("_payload", T.unicode_trim(T.trim_nul(data))).where(F.col("_payload") != "")
    return S.with_syslog(p, "_payload", "parsed", mode).withColumn("ndjson", S.syslog_json("parsed", source_ip, ts)) \
        .drop("_payload")
