"""SNK-03 at scale: batches as rows of a table, gzip bytes included.

One folder (or file) per batch is one commit entry per batch; at 100 TB in
batches of 45 MB that is millions. Here a batch is a row (identity, counts,
sizes, gzip data) of a Parquet table partitioned by tenant and dataset, and a
file holds many. Lines are streamed through the compressor in order: a task
holds the compressed bytes of one batch, never its lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import text as TX

KEYS = ("tenant_id", "dataset_id", "data_hint")
COUNTS = "line_count long, total_bytes long, first_nanos long, compressed_bytes long, data binary"
GZIP = 31  # zlib window bits of the gzip container
LEVEL = 6
READ = 1 << 16


def compress_batches(lines: DataFrame, keys: Sequence[str] = KEYS, batch: str = "batch_no",
                     order: Sequence[str] = ("seq", "line_no"), line: str = "line", nanos: str = "nanos") -> DataFrame:
    """One row per batch: keys, batch, non-blank lines, bytes (a newline per
    line), the first line's time and the gzip data. The batches of a key are
    spread over tasks; a batch is built by one."""
    cols = [*keys, batch]
    blank = TX.is_blank(line).alias("_blank")
    d = lines.select(*cols, *order, F.col(nanos).alias("_nanos"), blank, F.concat(F.col(line), F.lit("\n")).cast("binary").alias("_line"))
    names = [*cols, *[f.split()[0] for f in COUNTS.split(", ")]]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key = packer = None
        parts: list[bytes] = []
        lines_n = total = first = 0

        def row() -> list:
            parts.append(packer.flush())
            data = b"".join(parts)
            return [*key, lines_n, total, first, len(data), data]

        for rb in batches:
            out = []
            values = zip(*(rb.column(c).to_pylist() for c in [*cols, "_nanos", "_blank", "_line"]))
            for *k, at, empty, text in values:
                if k != key:
                    if key is not None:
                        out.append(row())
                    key, packer, parts, lines_n, total, first = k, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0, 0, at
                lines_n += not empty
                total += len(text)
                if piece := packer.compress(text):
                    parts.append(piece)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*[row()]))), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = ", ".join(f"{c} {dict(lines.dtypes)[c]}" for c in cols)
    arrow = to_arrow_schema(lines.sparkSession.createDataFrame([], f"{fields}, {COUNTS}").schema)
    return d.repartition(*cols).sortWithinPartitions(*cols, *order).mapInArrow(run, f"{fields}, {COUNTS}")


def write_batch_table(batches: DataFrame, path: str, mode: str = "append") -> None:
    """Write compressed batches with their file names (PRJ-03)."""
    name = N.batch_filename("tenant_id", "dataset_id", "first_nanos", "data_hint")
    d = batches.withColumn("filename", name).withColumn("id", N.batch_id("tenant_id", "dataset_id", "first_nanos", "data_hint"))
    d.write.mode(mode).partitionBy("tenant_id", "dataset_id").parquet(path)


def scan_batch_table(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all stored batches: identity, line_no and value. The data
    is inflated piece by piece."""
    d = spark.read.parquet(path).select("id", "batch_no", "data")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rb in batches:
            for ident, number, data in zip(*(rb.column(c).to_pylist() for c in ("id", "batch_no", "data"))):
                reader, rest, at = zlib.decompressobj(GZIP), b"", 0
                while data:
                    rest += reader.decompress(data, READ)
                    data = reader.unconsumed_tail
                    *whole, rest = rest.split(b"\n")
                    if whole:
                        yield pa.RecordBatch.from_pydict({
                            "id": [ident] * len(whole), "batch_no": [number] * len(whole),
                            "line_no": list(range(at, at + len(whole))),
                            "value": pa.array([w.decode("utf-8", "replace") for w in whole], pa.string())})
                        at += len(whole)

    return d.mapInArrow(run, "id string, batch_no long, line_no long, value string")
