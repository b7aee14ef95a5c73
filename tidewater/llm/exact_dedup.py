"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every row gets the SHA-256 of its normalised text; that narrow table is
   written with the scan task (the sender) each row came from.
2. A sender sorts its fingerprints, drops its own repeats and sends each
   owner (a range of fingerprints) its share as Golomb-Rice coded gaps.
3. An owner decodes all lists and answers each sender with a bitmap of the
   fingerprints that another sender holds too.
4. Rows that a bitmap (or the sender itself) marks are suspects. Only their
   texts are grouped byte for byte; everything else is unique.

Copies are collapsed before each shuffle: a text that makes up a third of all
rows costs one fingerprint per sender in step 2 and one text per task in
step 4.

Defined results: a NULL text counts as empty; of equal texts the smallest
doc_id stays, NULL doc_ids stay only where all are NULL; a row repeated with
the same id and text is one group of several rows, of which one is kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows

# Runs of white space other than one single space.
_RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
FP_BITS = 60
# Fingerprints differ by chance once in 2 ** SPARE_BITS rows or so.
SPARE_BITS = 16
ROWS_PER_OWNER = 500_000
LEAST_OWNERS = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def rice_encode(gaps) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of non-negative gaps: bits of the remainder, the
    quotients in unary, the remainders in binary."""
    import numpy as np

    gaps = np.asarray(gaps, dtype=np.uint64)
    mean = float(gaps.mean()) if len(gaps) else 0.0
    k = max(0, int(math.floor(math.log2(mean * math.log(2))))) if mean * math.log(2) >= 1 else 0
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), dtype=np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, low: bytes):
    """The gaps that ``rice_encode`` was given."""
    import numpy as np

    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    q = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    if not k or not n:
        return q
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[:n * k].reshape(n, k).astype(np.uint64)
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    return (q << np.uint64(k)) | (bits << shifts).sum(axis=1, dtype=np.uint64)


def _shares(fps, bits: int, owner_bits: int):
    """A sender's distinct fingerprints by owner: (owner, sorted slice)."""
    import numpy as np

    fps = np.unique(fps >> (FP_BITS - bits))
    owners = fps >> (bits - owner_bits)
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(fps)]):
        yield int(owners[s]), s, e, fps


def suspects(digests: DataFrame) -> DataFrame:
    """``digests`` (fp, sender, ...) with ``suspect``: whether the fingerprint
    occurs in another row. ``digests`` must be a written table."""
    total = digests.count()
    owner_bits = max(LEAST_OWNERS.bit_length() - 1, math.ceil(math.log2(max(1, total / ROWS_PER_OWNER))))
    bits = min(FP_BITS, max(owner_bits + 8, math.ceil(math.log2(total + 1)) + SPARE_BITS))

    def send(key, rows):
        import numpy as np
        import pyarrow as pa

        out = []
        for owner, s, e, fps in _shares(rows.column("fp").to_numpy(), bits, owner_bits):
            k, unary, low = rice_encode(np.diff(fps[s:e], prepend=owner << (bits - owner_bits)))
            out.append((owner, key[0].as_py(), e - s, k, unary, low))
        names = ["owner", "sender", "n", "k", "unary", "low"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def answer(rows):
        import numpy as np
        import pyarrow as pa

        owner = rows.column("owner")[0].as_py()
        lists = []
        for n, k, unary, low in zip(*(rows.column(c).to_pylist() for c in ("n", "k", "unary", "low"))):
            gaps = rice_decode(n, k, unary, low)
            lists.append(np.cumsum(gaps.astype(np.int64)) + (owner << (bits - owner_bits)))
        merged = np.concatenate(lists)
        order = np.argsort(merged, kind="stable")
        same = np.diff(merged[order]) == 0
        shared = np.zeros(len(merged), dtype=bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        ends = np.cumsum([len(x) for x in lists])
        maps = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
        return pa.table([rows.column("owner"), rows.column("sender"), pa.array(maps, pa.binary())],
                        names=["owner", "sender", "bitmap"])

    def mark(_, rows, answers):
        import numpy as np
        import pyarrow as pa

        raw = rows.column("fp").to_numpy()
        got = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()))
        short, count = np.unique(raw >> (FP_BITS - bits), return_counts=True)
        flag = count > 1
        for owner, s, e, _fps in _shares(raw, bits, owner_bits):
            flag[s:e] |= np.unpackbits(np.frombuffer(got[owner], np.uint8))[:e - s].astype(bool)
        hit = flag[np.searchsorted(short, raw >> (FP_BITS - bits))]
        return rows.select([c for c in rows.column_names if c not in ("fp", "sender")]) \
            .append_column("suspect", pa.array(hit))

    messages = digests.select("sender", "fp").groupBy("sender").applyInArrow(
        send, "owner int, sender int, n long, k int, unary binary, low binary")
    answers = messages.groupBy("owner").applyInArrow(answer, "owner int, sender int, bitmap binary")
    fields = [f for f in digests.schema.fields if f.name not in ("fp", "sender")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return digests.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark, schema + ", suspect boolean")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sha = F.sha2(normalised(F.col("text")), 256)
    digests = cut(narrow.select("doc_id", sha.alias("sha"), F.spark_partition_id().alias("sender"))
                  .select("doc_id", F.unhex("sha").alias("sha"), "sender",
                          F.conv(F.substring("sha", 1, FP_BITS // 4), 16, 10).cast("long").alias("fp")))
    marked = cut(suspects(digests))
    unique = marked.where(~F.col("suspect"))
    doubt = marked.where("suspect").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("rows"))

    # Byte verification: the suspects' texts themselves are the grouping key,
    # and copies within a task meet before the shuffle.
    nothing = F.lit(-(1 << 63))
    ids = marked.where("suspect").select(F.coalesce("doc_id", nothing).alias("_k")).distinct()
    texts = narrow.withColumn("_k", F.coalesce("doc_id", nothing)).join(ids.hint("shuffle_hash"), "_k", "left_semi") \
        .select("doc_id", normalised(F.col("text")).alias("norm")) \
        .groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = texts.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size") \
        .groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
                            F.count(F.lit(1)).alias("texts")) \
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two different texts have one SHA-256 digest")).cast("long")))
    copies = doubt.join(groups, "sha") \
        .select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).drop("nth")
    single = unique.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                           "sha", F.lit(True).alias("kept"))
    return single.unionByName(copies).select("doc_id", "keep_id", "group_size", "kept",
                                             F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat a text; all columns stay."""
    keep = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return keep_rows(docs, keep, F.sha2(normalised(F.col("text")), 256))
