"""Readers for the landing tables the operators consume.

Every reader names its columns so the Parquet scan only materialises what
the plan uses (``ReadSchema`` in ``explain``); Catalyst still prunes further
when a caller projects less. Tables are read as Spark splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one driver table, optionally pruned to ``columns``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
