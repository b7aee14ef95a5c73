"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, prepare

# White space of the word rules: space and the ASCII control range 0x09-0x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


# Batches handed to Python workers: long texts make the usual number of rows
# too large.
ARROW_BATCH = "8m"
# For a scan that only hands whole texts on to Python: the reader decodes so
# many rows at a time and a worker gets so many bytes at a time. Larger buffers
# make an executor's heap grow and are no faster, as the workers set the pace.
SMALL_BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": "1m",
}


def settle(spark: SparkSession) -> SparkSession:
    """The session settings that the operators need."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark


@contextmanager
def holding(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; the former ones return."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read as Spark splits it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidewater-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends at the written files, so a lost executor costs a re-read
    of its splits and never a recomputation of the whole chain.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keep_rows(docs: DataFrame, keep: DataFrame, digest: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``keep``.

    With ``digest``, a column over ``docs``, the column ``digest`` of ``keep``
    must agree as well. A repeated row comes back once; NULL ids match NULL
    ids, and rows without an id are told apart by their text. ``keep`` is the
    hashed side, so the texts are shuffled once and not sorted for the join.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_k")
    tell = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("_tell")
    left = docs.select("*", key, tell, *([digest.alias("_digest")] if digest is not None else []))
    on = ["_k"] + ["_digest"] * (digest is not None)
    right = keep.select(key, *([F.col("digest").alias("_digest")] if digest is not None else [])).distinct()
    return left.join(right.hint("shuffle_hash"), on, "left_semi").dropDuplicates([*on, "_tell"]).drop(*on, "_tell")
