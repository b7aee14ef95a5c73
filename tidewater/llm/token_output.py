"""Training-order materialisation of token ids.

Each scan task joins its documents' ids, an end id after each, and cuts the
run into sequences of ``length`` ids (the task's last one is filled up with
end ids). Sequences are numbered over all tasks; a keyed Feistel network with
cycle-walking permutes these numbers, so every sequence gets a global slot
without a sort by random keys, and the inverse is computable. Slots are dealt
by range into shards; a shard is written in slot order with a fixed stride, so
slot s lies at byte (s mod per_shard) * stride of shard s div per_shard. A
reader goes on from any slot with one seek.

A record is the sequence's little-endian unsigned 16-bit ids and one end id.
Shards are written by Spark's text writer, with the record as line.

Sequences are staged once as compressed Parquet, since their number must be
known before the first slot is; the stage is what a lost executor re-reads.

Defined results: a NULL or empty text adds its end id alone; repeated rows are
written as often as they occur; a NULL doc_id is carried along; an empty table
gives no shard and an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, new_folder
from .token_files import END_ID, separator, to_ids16

LENGTH = 2048
PER_SHARD = 4096
KEY = 0x5DEECE66D


class Feistel:
    """A keyed permutation of range(n): a balanced network on the next even
    number of bits, walked along its cycle until the value is below n."""

    ROUNDS = 6

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
        self.keys = [(key * (2 * r + 1) + r * 0x9E3779B97F4A7C15) % (1 << 64) for r in range(self.ROUNDS)]

    def _round(self, x, key: int):
        import numpy as np

        x = (x + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x, back: bool):
        import numpy as np

        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def __call__(self, values, back: bool = False):
        """Slots of numbers, or with ``back`` the numbers of slots."""
        import numpy as np

        out = self._once(np.asarray(values, dtype=np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)


def stage_sequences(docs: DataFrame, length: int, tokenizer_path: str | None) -> DataFrame:
    """(task, nth, doc_id of the first id, packed ids) of all sequences."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        enc = tokens.worker_encoder(tokenizer_path, plain=True)
        end, step = END_ID.to_bytes(2, "little"), 2 * length
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        rest, owner, nth = b"", None, 0

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                names=["nth", "doc_id", "packed"])

        for part in parts:
            keys = part.column("doc_id").to_pylist()
            for at, texts in tokens.batches(part.column("text")):
                rows, run_of, marks, size = [], [rest], [(0, owner)] if rest else [], len(rest)
                for key, ids in zip(keys[at:at + len(texts)], to_ids16(enc, texts)):
                    marks.append((size, key))
                    run_of += (ids, end)
                    size += len(ids) + 2
                joined, m = b"".join(run_of), 0
                for s in range(0, size - step + 1, step):
                    while m + 1 < len(marks) and marks[m + 1][0] <= s:
                        m += 1
                    rows.append((nth, marks[m][1], squeeze(joined[s:s + step])))
                    nth += 1
                left = size - size % step
                rest = joined[left:]
                owner = next((k for s, k in reversed(marks) if s <= left), None)
                if rows:
                    yield batch(rows)
        if rest:
            yield batch([(nth, owner, squeeze(rest + end * ((step - len(rest)) // 2)))])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = narrow.mapInArrow(run, "nth long, doc_id long, packed binary")
    return cut(made.select(F.spark_partition_id().alias("task"), "*"))


def materialise(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
                tokenizer_path: str | None = None) -> DataFrame:
    """Write the shards to ``path``; returns (slot, doc_id) of all sequences."""
    stage = stage_sequences(docs, length, tokenizer_path)
    counts = stage.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    total = stage.count()
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row a scan task. Written, its size is known to the planner, which
    # broadcasts it if it is small; the staged ids are then not shuffled for it.
    offsets = cut(counts.select("task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before")))

    def place(parts: Iterator) -> Iterator:
        import pyarrow as pa

        permute = Feistel(total, key)
        for part in parts:
            slots = pa.array(permute(part.column("number").to_numpy()))
            names = [c for c in part.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [slots], names=[*names, "slot"])

    def unpack(parts: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                ids = [grow(x) for x in some.column("packed").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("shard"), some.column("slot"), pa.array(ids, pa.binary())],
                                                 names=["shard", "slot", "ids"])

    numbered = stage.join(offsets, "task").withColumn("number", F.col("before") + F.col("nth"))
    if total:
        shards = -(-total // per_shard)
        slotted = numbered.select("packed", "number").mapInArrow(place, "packed binary, slot long") \
            .withColumn("shard", F.expr(f"slot div {per_shard}"))
        # Whole shards to a task. Sorted right before the write: the writer
        # takes this order, and adds no sort by shard alone, whose spills would
        # lose the order of slots.
        dealt = slotted.repartition(min(shards, 10_000), "shard").select("shard", "slot", "packed")
        dealt.mapInArrow(unpack, "shard long, slot long, ids binary").sortWithinPartitions("shard", "slot") \
            .select(F.col("ids").cast("string"), "shard").write.partitionBy("shard").options(**separator()).text(path)
    return numbered.select("doc_id", "number").mapInArrow(place, "doc_id long, slot long")


def read_slots(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD,
               first: int = 0, stop: int | None = None, summary: bool = False) -> DataFrame:
    """The records of slots ``first`` up to ``stop``: slot, shard,
    byte_offset, ids. Only the shards that hold them are read. ``summary``
    gives ids_crc32 and n_ends (end ids) instead of the ids."""
    stride = 2 * (length + 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path) \
        .where(F.col("shard") >= first // per_shard)
    if stop is not None:
        files = files.where(F.col("shard") <= (max(stop, 1) - 1) // per_shard)

    def run(parts: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for part in parts:
            for i, shard in enumerate(part.column("shard").to_pylist()):
                raw = memoryview(part.column("content")[i].as_buffer())
                for at in range(0, len(raw), stride * 512):
                    spots = range(at, min(at + stride * 512, len(raw)), stride)
                    ids = [raw[s:s + 2 * length] for s in spots]
                    if summary:
                        last = [pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                                pa.array([int((np.frombuffer(x, "<u2") == END_ID).sum()) for x in ids], pa.int64())]
                    else:
                        last = [pa.array([bytes(x) for x in ids], pa.binary())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard * per_shard + s // stride for s in spots], pa.int64()),
                         pa.array([shard] * len(spots), pa.int64()), pa.array(list(spots), pa.int64()), *last],
                        names=["slot", "shard", "byte_offset", *(["ids_crc32", "n_ends"] if summary else ["ids"])])

    rows = files.select(F.col("shard").cast("long").alias("shard"), "content") \
        .mapInArrow(run, "slot long, shard long, byte_offset long, " + ("ids_crc32 long, n_ends long" if summary else "ids binary"))
    rows = rows.where(F.col("slot") >= first)
    return rows if stop is None else rows.where(F.col("slot") < stop)


def shard_digest(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
                 tokenizer_path: str | None = None) -> DataFrame:
    """Materialise ``docs`` and read everything back: slot, shard,
    byte_offset, n_ends (end ids in the sequence), ids_crc32, doc_id (of the
    sequence's first id)."""
    path = new_folder(docs.sparkSession)
    placed = materialise(docs, path, length, per_shard, key, tokenizer_path)
    if not placed.take(1):
        return placed.select("slot", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("long").alias("byte_offset"),
                             F.lit(None).cast("long").alias("n_ends"), F.lit(None).cast("long").alias("ids_crc32"), "doc_id")

    read = read_slots(docs.sparkSession, path, length, per_shard, summary=True)
    return read.join(placed, "slot").select("slot", "shard", "byte_offset", "n_ends", "ids_crc32", "doc_id")
