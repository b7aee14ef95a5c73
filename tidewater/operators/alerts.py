"""Alert and report tables (ALR-*): thresholds over statistics rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
# DLQ alert thresholds and disk-space alert ratios.
DLQ_BYTES_ALERT = 500 * MIB
DLQ_FILES_ALERT = 1000
SPACE_CRITICAL_PCT = 95
SPACE_HIGH_PCT = 85


def dlq_alerts(stats: DataFrame) -> DataFrame:
    """ALR-01: from AGG-01 rows, one alert row per breached DLQ threshold
    (size > 500 MiB, count > 1000), severity high. Scope: every level."""
    size = stats.where(F.col("dlq_bytes") > DLQ_BYTES_ALERT).select(
        "tenant_id", "dataset_id", "level", F.lit("dlq_size").alias("alert"), F.lit("high").alias("severity"),
        F.col("dlq_bytes").alias("observed"), F.lit(DLQ_BYTES_ALERT).cast("long").alias("threshold"))
    count = stats.where(F.col("dlq_files") > DLQ_FILES_ALERT).select(
        "tenant_id", "dataset_id", "level", F.lit("dlq_count").alias("alert"), F.lit("high").alias("severity"),
        F.col("dlq_files").alias("observed"), F.lit(DLQ_FILES_ALERT).cast("long").alias("threshold"))
    return size.unionByName(count)


def space_alerts(usage: DataFrame, used: str = "used_bytes", cap: str = "max_bytes") -> DataFrame:
    """ALR-02: used/max above 95 % -> critical, above 85 % -> high.

    Integer arithmetic (``used * 100 > pct * max``) keeps the rule exact.
    """
    u, m = F.col(used).cast("long"), F.col(cap).cast("long")
    sev = (F.when((m > 0) & (u * 100 > m * SPACE_CRITICAL_PCT), F.lit("critical"))
           .when((m > 0) & (u * 100 > m * SPACE_HIGH_PCT), F.lit("high")))
    return usage.withColumn("severity", sev).where(F.col("severity").isNotNull())


def alert_records(df: DataFrame, severity: Column, title: Column, message: Column, details: Column,
                  ts: Column, service: str = "tidewater", version: str = "0.1.0", keep=()) -> DataFrame:
    """ALR-03: shape rows into the alert/report record (severity defaults
    to ``error`` when missing); ``keep`` carries identifying columns."""
    return df.select(
        *keep, F.coalesce(severity, F.lit("error")).alias("severity"), title.alias("title"), message.alias("message"),
        details.alias("details"), F.lit(service).alias("service"), F.lit(version).alias("version"),
        ts.alias("timestamp"))


def health_report(status: DataFrame, throughput: DataFrame, inventory: DataFrame, key: str = "instance") -> DataFrame:
    """ALR-04: one health record per instance from the status (WIN-03),
    throughput (AGG-06) and input inventory (AGG-07) rows."""
    return status.join(throughput, key, "left").join(inventory, key, "left").select(
        key, (F.col("status") == "healthy").alias("healthy"), "status",
        *[c for c in throughput.columns if c != key], *[c for c in inventory.columns if c != key])
