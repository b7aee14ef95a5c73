"""Best-fit packing of documents into training sequences.

Large-item matching: pieces above a third of the capacity are paired, at most
two to a bin, by a greedy matching from the longest down; shorter pieces then
best-fit the remaining gaps, longest first. A packing depends on lengths only,
so it is decided on the histogram of lengths, which has at most ``capacity``
entries whatever the corpus size: runs of equal pieces are placed into runs of
equal bins. Spark builds the histogram, ranks the pieces within their length
and looks each rank up in the resulting table of runs.

Defined results: a NULL or empty text is the end id alone (length 1); repeated
rows are packed as often as they occur; a NULL doc_id is carried along; an
empty table gives an empty result; columns besides doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import SMALL_BATCHES, cut, holding

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Pieces of one length are ranked in this many rows at a time.
ROWS_PER_SALT = 200_000
MOST_SALTS = 4096


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None,
               end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut each document's ids, the end
    id included, into pieces of at most ``capacity``; ``with_ids`` adds the
    ids as little-endian unsigned 32-bit numbers."""
    end = end_id.to_bytes(4, "little")
    step = capacity * 4

    def run(parts: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        enc = tokens.worker_encoder(tokenizer_path)
        for part in parts:
            keys = part.column("doc_id").to_pylist()
            for first, texts in tokens.batches(part.column("text")):
                rows = []
                for key, raw in zip(keys[first:first + len(texts)], enc.encode_many(texts)):
                    raw += end
                    for i in range(0, len(raw), step):
                        ids = raw[i:i + step]
                        rows.append((key, i // step, i // 4, len(ids) // 4, zlib.crc32(ids), ids))
                cols = list(zip(*rows))[:5 + with_ids]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], names=names[:len(cols)])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place every piece of a length histogram.

    Returns runs (length, first rank, first bin, pieces per bin, offset): the
    pieces of that length with ranks from the first on (up to the next run of
    the length) fill the bins from the first on, that many to a bin, from that
    offset on. Within a bin the pieces lie gapless from 0.
    """
    import bisect

    left = {k: n for k, n in histogram.items() if n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}

    def place(length: int, first_bin: int, count: int, per_bin: int, offset: int) -> None:
        runs.append((length, used[length], first_bin, per_bin, offset))
        used[length] += count * per_bin
        left[length] -= count * per_bin

    def gap(size: int, first_bin: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first_bin, count))

    sizes: list[int] = []
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:  # no large piece fits beside it
            n = left[a]
            place(a, bins, n, 1, 0)
            gap(capacity - a, bins, n)
            large.pop()
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b and not n:
                # The last one of its length: the next shorter one is its mate.
                b = large[at - 1] if at else None
                n = 1
            if b is None:
                place(a, bins, 1, 1, 0)
                gap(capacity - a, bins, 1)
            elif a == b:
                place(a, bins, n, 2, 0)
                gap(capacity - 2 * a, bins, n)
            else:
                place(a, bins, n, 1, 0)
                place(b, bins, n, 1, a)
                gap(capacity - a - b, bins, n)
            large = [k for k in large if left[k]]
        bins += n
    for s in sorted((k for k in left if left[k]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(sizes, s)
            if at == len(sizes):  # a new bin, or as many as are filled alike
                per = min(capacity // s, left[s])
                n = left[s] // per
                place(s, bins, n, per, 0)
                gap(capacity - per * s, bins, n)
                bins += n
                continue
            g = sizes[at]
            first, count = gaps[g].pop()
            if not gaps[g]:
                del gaps[g], sizes[at]
            per = min(g // s, left[s])
            n = min(count, left[s] // per)
            place(s, first, n, per, capacity - g)
            gap(g - per * s, first, n)
            gap(g, first + n, count - n)
    return runs


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces.

    ``pieces`` is read twice, so hand over a written table. The collected
    histogram and the runs made from it are bounded by the capacity alone.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan_runs(histogram, capacity))
    total = sum(histogram.values())
    salts = max(1, min(MOST_SALTS, -(-total // ROWS_PER_SALT)))

    # Ranks within a length, in two levels: a length that holds a third of
    # all pieces is spread over the salts.
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(inside)).join(sums, ["length", "_salt"]) \
        .withColumn("_rank", F.col("_before") + F.col("_in") - 1)

    def find(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.array(runs, dtype=np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 48) + table[:, 1]
        for part in parts:
            length = part.column("length").to_numpy()
            rank = part.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            k = rank - table[at, 1]
            sequence = table[at, 2] + k // table[at, 3]
            offset = table[at, 4] + k % table[at, 3] * length
            names = [c for c in part.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names] + [pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    out = ranked.select(*names, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return out.mapInArrow(find, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None,
                   end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    with holding(docs.sparkSession, SMALL_BATCHES):
        pieces = cut(cut_pieces(docs, capacity, tokenizer_path, end_id, with_ids))
    return pack(pieces, capacity)
