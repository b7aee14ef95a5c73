"""Flat token files: writing, scanning for separators, counting.

A token file is a run of little-endian unsigned 16-bit ids and nothing else;
each document ends with the end-of-document id. There is no index: document
boundaries are found by scanning.

Scan: each file is read in blocks of ``BLOCK`` ids; a block finds its
separators with one vectorised comparison and reports how far its last
document reaches. A running maximum over the blocks of a file (a prefix scan)
tells every block where the document that is open at its start began, which
stitches documents across any number of blocks.

Files are written by Spark's text writer: the ids are the line and the
separator is the end of line, so file names, retries and commits are Spark's,
on any store that Spark can write.

Defined results: a NULL or empty text is a document of its separator alone; a
NULL doc_id is carried along; a repeated row is written and counted again; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import new_folder

# The word tokenizer's own end id; the strings of special ids are ordinary text.
END_ID = 49407
BLOCK = 1 << 20


def separator() -> dict[str, str]:
    """Options of the text writer that end each line with the end id."""
    return {"lineSep": END_ID.to_bytes(2, "little").decode("latin-1"), "encoding": "ISO-8859-1"}


def to_ids16(encoder, texts) -> list:
    """Ids of each text as little-endian unsigned 16-bit numbers."""
    import numpy as np

    raw = encoder.encode_many(texts)
    all_ids = np.frombuffer(b"".join(raw), "<u4").astype("<u2").tobytes()
    out, at = [], 0
    for r in raw:
        out.append(all_ids[at:at + len(r) // 2])
        at += len(r) // 2
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None) -> None:
    """Write the documents' ids, one file a task, in the order of the rows."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        enc = tokens.worker_encoder(tokenizer_path, plain=True)
        for part in parts:
            for _, texts in tokens.batches(part.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(to_ids16(enc, texts), pa.binary())], names=["ids"])

    ids = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "ids binary")
    ids.select(F.col("ids").cast("string")).write.options(**separator()).text(path)


def task_of_file(name: Column) -> Column:
    """The number of the task that wrote a file."""
    return F.regexp_extract(name, "part-(\\d+)", 1).cast("int")


def scan_token_files(spark: SparkSession, path: str, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """One row per document of the files: shard, nth (in its file), start (in
    ids) and n_tokens, the separator not counted. Ids after the last separator
    of a file are a last document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path) \
        .select(task_of_file(F.element_at(F.split("path", "/"), -1)).alias("shard"), "content")

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = "<u2"
        for part in parts:
            for i, shard in enumerate(part.column("shard").to_pylist()):
                ids = np.frombuffer(part.column("content")[i].as_buffer(), kind)
                for b, at in enumerate(range(0, len(ids), block)):
                    piece = ids[at:at + block]
                    ends = np.flatnonzero(piece == end_id) + at
                    over = at + block >= len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([b], pa.int32()), pa.array([ends], pa.list_(pa.int64())),
                         pa.array([len(ids) if over else None], pa.int64())],
                        names=["shard", "block", "ends", "total"])

    blocks = files.mapInArrow(run, "shard int, block int, ends array<long>, total long")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.withColumn("last", F.try_element_at("ends", F.lit(-1))) \
        .withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long"))) \
        .withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0).cast("long")))
    # The document that no separator ends, if there is one.
    reach = F.coalesce(F.col("last") + 1, F.col("open"))
    ends = F.when(F.col("total") > reach, F.array_append("ends", F.col("total"))).otherwise(F.col("ends"))
    rows = stitched.withColumn("ends", ends).select(
        "shard", "open", "first", "ends", F.posexplode("ends").alias("pos", "end"))
    start = F.when(F.col("pos") == 0, F.col("open")).otherwise(F.expr("try_element_at(ends, pos)") + 1)
    return rows.select("shard", (F.col("first") + F.col("pos")).alias("nth"), start.alias("start"),
                       (F.col("end") - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Token counts of all documents by writing and scanning token files:
    doc_id, shard, nth, start, n_tokens.

    ``docs`` must be a table as read: the ids come from a second scan with the
    same splits, whose rows are numbered as the first one wrote them, and the
    counts of both must agree.
    """
    spark = docs.sparkSession
    path = new_folder(spark)
    write_token_files(docs, path, tokenizer_path)
    at = F.monotonically_increasing_id()
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), at.alias("_at")) \
        .select("doc_id", F.lit(True).alias("named"), F.shiftright("_at", 33).cast("int").alias("shard"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("nth"))
    joined = scan_token_files(spark, path).join(names, ["shard", "nth"], "full")
    agreed = F.col("named").isNotNull() & F.col("n_tokens").isNotNull()
    return joined.select("doc_id", "shard", "nth", "start", F.when(agreed, F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("the two scans of the documents differ")).cast("long")).alias("n_tokens"))
