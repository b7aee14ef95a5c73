"""Small gzip objects in a shared folder, written and read by tasks.

An object per batch means millions of objects of a few hundred bytes. Spark's
file writer and reader are made for large files: on a shared folder (``file``
scheme) each small one costs several processes to set its mode, and the
driver lists and keeps every name. Here a task writes its objects itself, and
folders are listed level by level in tasks, so nothing about single objects
passes the driver. The layout is that of Spark's partitioned text writer.

An object is written under a hidden name and then renamed, and its name is
fixed by the call and the task: a task that runs again replaces its own
objects, and no reader sees half of one. Other schemes have no such folders:
there the callers use Spark's writer and reader.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP = 31  # zlib window bits of the gzip container
LEVEL = 6
# Scheme and path; names of folders as Spark writes them: escaped characters,
# NULL and empty.
URL = re.compile("(?:([A-Za-z][A-Za-z0-9+.-]*):(?://[^/]*)?)?(.*)", re.S)
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
READ_ROWS = 256


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks open it, or None where it is not in a ``file`` folder."""
    scheme, rest = URL.fullmatch(path).groups()
    if scheme is None:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        scheme = URL.fullmatch(default)[1]
    return rest if scheme == "file" else None


def folder_name(column: str, value) -> str:
    text = "" if value is None else str(value)
    return f"{column}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', text) or NO_VALUE}"


def folder_value(name: str) -> str | None:
    value = name.split("=", 1)[1]
    return None if value == NO_VALUE else unquote(value)


def write_objects(rows: DataFrame, folder: str, columns: Sequence[str], line: str = "value") -> int:
    """Write ``rows``, in which the rows of an object are neighbours and in
    one task, as one gzip text object per value of ``columns``; returns how
    many."""
    columns, call = list(columns), uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{call}.txt.gz"
        key = packer = out = held = None
        made = 0

        def close() -> None:
            out.write(packer.flush())
            out.close()
            os.replace(held, os.path.join(os.path.dirname(held), name))

        for rb in batches:
            for *k, text in zip(*(rb.column(c).to_pylist() for c in [*columns, line])):
                if k != key:
                    if key is not None:
                        close()
                    at = os.path.join(folder, *[folder_name(c, v) for c, v in zip(columns, k)])
                    os.makedirs(at, exist_ok=True)
                    held = os.path.join(at, f"_{name}.{task.taskAttemptId()}")
                    key, packer, out = k, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), open(held, "wb")
                    made += 1
                out.write(packer.compress(f"{text or ''}\n".encode()))
        if key is not None:
            close()
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.int64())})

    return rows.select(*columns, line).mapInArrow(run, "made long").agg(F.sum("made")).first()[0] or 0


def read_objects(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """Every object below ``folder``: ``columns`` (text) and ``value``, the
    whole text."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def below(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rb in batches:
            for at in rb.column("at").to_pylist():
                names = sorted(e.name for e in os.scandir(os.path.join(folder, at)) if e.is_dir() and "=" in e.name)
                yield pa.RecordBatch.from_pydict({"at": pa.array([os.path.join(at, x) for x in names], pa.string())})

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=[*columns, "value"])

        for rb in batches:
            found = []
            for at in rb.column("at").to_pylist():
                keys = [folder_value(x) for x in at.split("/")]
                for name in sorted(os.listdir(os.path.join(folder, at))):
                    if name.startswith(("_", ".")) or not name.endswith(".gz"):
                        continue
                    with open(os.path.join(folder, at, name), "rb") as f:
                        found.append((*keys, gzip.decompress(f.read()).decode("utf-8", "replace")))
                    if len(found) == READ_ROWS:
                        yield told(found)
                        found = []
            if found:
                yield told(found)

    at = spark.createDataFrame([("",)], "at string")
    for _ in columns:
        at = at.mapInArrow(below, "at string").repartition(n, "at")
    return at.mapInArrow(read, ", ".join(f"`{c}` string" for c in [*columns, "value"]))
