"""Session helpers: the runtime settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that operators depend on for correct results. All are runtime
# SQL confs, so they can be applied to a session the caller already owns.
REQUIRED_CONF = {
    # Timestamps are rendered (RFC3339, epoch millis) in UTC.
    "spark.sql.session.timeZone": "UTC",
    # JSON documents may legally repeat a key; last one wins like Go maps.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # map_concat(base, custom) must let the custom side win.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings tuned for scale; applied only when the caller has not set them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Python folds stream Arrow batches of this many rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "65536",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings operators need to an existing session."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must name a shared filesystem
    folder; only a local session (tests) gets one of its own when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tidewater-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidewater") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
