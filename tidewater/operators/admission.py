"""Request admission (VAL-06): the ordered reject ladder of a webhook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(headers: Column, name: str) -> Column:
    """A header by its name in any case; NULL when absent."""
    return F.element_at(F.transform_keys(headers, lambda k, v: F.lower(k)), F.lit(name.lower()))


def admit_requests(requests: DataFrame, bearer_token: str = "", max_payload: int = 10 * 1024 * 1024,
                   max_lines: int = 10_000, auth: bool = True) -> DataFrame:
    """VAL-06: method != POST -> 405; bad token -> 401; declared length >
    max -> 413; the body is cut to max bytes; ``\\n`` count + 1 > max lines
    -> 413; else accepted (200). Adds ``code``, ``reason`` and the cut
    ``body`` as bytes: a cut may fall inside a character."""
    auth_ok = F.lit(True)
    if auth and bearer_token:
        auth_ok = F.coalesce(header(F.col("headers"), "Authorization"), F.lit("")) == f"Bearer {bearer_token}"
    body = F.substring(F.col("body").cast("binary"), 1, max_payload)
    text = body.cast("string")
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    code = (F.when(F.col("method") != "POST", F.lit(405)).when(~auth_ok, F.lit(401))
            .when(F.col("declared_length") > max_payload, F.lit(413))
            .when(lines > max_lines, F.lit(413)).otherwise(F.lit(200)))
    reason = (F.when(F.col("method") != "POST", F.lit("method_not_allowed")).when(~auth_ok, F.lit("unauthorized"))
              .when(F.col("declared_length") > max_payload, F.lit("payload_too_large"))
              .when(lines > max_lines, F.lit("too_many_lines")).otherwise(F.lit("accepted")))
    return requests.withColumn("code", code).withColumn("reason", reason).withColumn("body", body)
