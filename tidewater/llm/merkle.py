"""A Merkle manifest of a table, stored in van Emde Boas order.

Every row is a leaf. Leaves of a group (a language) are numbered in order and
dealt into aligned blocks of ``FAN ** LEVELS``; a task builds a block's whole
subtree and stores its nodes in one binary value, in which a subtree is split
at half its height again and again: first the upper half, then the lower
subtrees from left to right. ``address`` computes a node's place from depth
and index alone; building a block and fetching siblings both go by it. The
block roots of a group are the leaves of the next tier of blocks, until one
root is left; the groups' roots get a tree of their own by the same steps.

Proofs go the other way. The tiers are joined downwards, so that each block
learns the siblings above its root, and a block's leaves get theirs from the
block and that path. A group with a third of all rows is only more blocks;
what grows per task is a block.

Defined results: leaves of a group go by doc_id, NULL first, ties by digest;
repeated rows are a leaf each; NULL fields are ``-`` in a digest; the NULL
group comes first; a NULL doc_id is carried along and never taken as altered;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running_sums
from .common import cut

FAN = 8
# Levels of a block above its leaves.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TIER = "key string, block long, size long, layout binary, root binary"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def nodes_in(levels: int) -> int:
    """Nodes of a complete subtree of so many levels, the leaves included."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(depth: int, index, levels: int):
    """The places, in a complete subtree of so many levels, of the nodes with
    these indices (a numpy array) at a depth."""
    if levels == 1:
        return index * 0
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    lower = levels - upper
    below = FAN ** (depth - upper)
    return nodes_in(upper) + index // below * nodes_in(lower) + address(depth - upper, index % below, lower)


def height(size: int) -> int:
    """Levels above the leaves of a block in a tier of ``size`` nodes."""
    h = 0
    while h < LEVELS and FAN ** h < size:
        h += 1
    return h


def build_block(digests: list[bytes], size: int) -> bytes:
    """A block's nodes in van Emde Boas order; absent ones are zero bytes."""
    import hashlib

    import numpy as np

    h = height(size)
    nodes = np.zeros((nodes_in(h + 1), 32), np.uint8)
    row = digests
    for depth in range(h, -1, -1):
        nodes[address(depth, np.arange(len(row)), h + 1)] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        text = b"".join(row).hex().encode()
        row = [hashlib.sha256(text[i:i + 64 * FAN]).digest() for i in range(0, len(text), 64 * FAN)]
    return nodes.tobytes()


def block_rows(layout: bytes, size: int, block: int) -> list[bytes]:
    """The block's levels from the leaves up to its root, each as hex text."""
    import numpy as np

    h, leaves = height(size), min(FAN ** LEVELS, size - block * FAN ** LEVELS)
    nodes = np.frombuffer(layout, np.uint8).reshape(-1, 32)
    rows = []
    for depth in range(h, -1, -1):
        rows.append(nodes[address(depth, np.arange(leaves), h + 1)].tobytes().hex().encode())
        leaves = -(-leaves // FAN)
    return rows


def siblings(rows: list[bytes], index: int) -> list[tuple[bytes, bytes]]:
    """Per level below the root: the run's digests left and right of the node."""
    found = []
    for row in rows[:-1]:
        first, at = index // FAN * FAN * 64, index * 64
        found.append((row[first:at], row[at + 64:first + FAN * 64]))
        index //= FAN
    return found


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(docs: DataFrame, **replaced: Column) -> Column:
    """SHA-256 of a row's fields, each with its length, as hex text;
    ``replaced`` gives other values for fields."""
    fields = [_field(replaced.get(c, docs[c])) for c in FIELDS]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def leaves_of(docs: DataFrame, **altered: Column) -> DataFrame:
    """The leaves of a documents table: key (its group), doc_id, digest, and
    ``seen``, the digest after the alteration, if any."""
    leaf = row_digest(docs)
    seen = row_digest(docs, **altered) if altered else leaf
    return docs.select(F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("-")).alias("key"),
                       docs["doc_id"].cast("long").alias("doc_id"), F.unhex(leaf).alias("digest"),
                       F.unhex(seen).alias("seen"))


def _tier(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Blocks of ``nodes`` (key, pos, size, digest and ``payload``)."""
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", *payload)))
    blocks = nodes.withColumn("block", F.expr(f"pos div {FAN ** LEVELS}")).groupBy("key", "block", "size") \
        .agg(items.alias("items")).select("key", "block", "size", *[F.col(f"items.{c}").alias(c) for c in ("digest", *payload)])

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            layouts = [build_block(d, n) for d, n in zip(part.column("digest").to_pylist(), part.column("size").to_pylist())]
            cols = [part.column(c) for c in ("key", "block", "size")]
            cols += [pa.array(layouts, pa.binary()), pa.array([x[:32] for x in layouts], pa.binary())]
            cols += [part.column(c) for c in payload]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "block", "size", "layout", "root", *payload])

    kinds = "".join(f", {c} array<{dict(nodes.dtypes)[c]}>" for c in payload)
    return blocks.mapInArrow(run, TIER + kinds)


def _grow(nodes: DataFrame, most: int, payload: list[str]) -> list[DataFrame]:
    """The tiers over ``nodes``, whose largest group has ``most``."""
    tiers = []
    while True:
        tier = cut(_tier(nodes, payload))
        tiers.append(tier)
        if most <= FAN ** LEVELS:
            return tiers
        most = -(-most // FAN ** LEVELS)
        nodes = tier.where(F.col("size") > FAN ** LEVELS).select(
            "key", F.col("block").alias("pos"), F.expr(f"(size + {FAN ** LEVELS - 1}) div {FAN ** LEVELS}").alias("size"),
            F.col("root").alias("digest"))
        payload = []


class Manifest:
    """The stored tiers: ``tiers`` of the groups' trees, ``top`` of the tree
    over their roots, ``groups`` (key, pos, digest: its root, tier: its last)
    and ``root`` (hex text, None for no rows)."""

    def __init__(self, leaves: DataFrame):
        kept = cut(leaves.withColumn("no", F.monotonically_increasing_id()))
        sizes = cut(kept.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
        most, total = sizes.agg(F.max("size"), F.count(F.lit(1))).first()
        self.root, self.tiers, self.top, self.groups = None, [], [], None
        if not total:
            return
        placed = running_sums(kept, {"pos": F.lit(1)}, ["key"], ["doc_id", "digest", "no"], inclusive=False)
        self.tiers = _grow(placed.join(sizes, "key").drop("no"), most, ["doc_id", "seen"])
        ends = [t.where((F.col("size") <= FAN ** LEVELS) & (F.col("block") == 0))
                .select("key", F.col("root").alias("digest"), F.lit(n).alias("tier")) for n, t in enumerate(self.tiers)]
        self.groups = cut(running_sums(reduce(DataFrame.unionByName, ends), {"pos": F.lit(1)}, [], ["key"], inclusive=False))
        over = self.groups.select(F.lit("").alias("key"), "pos", F.lit(total).cast("long").alias("size"), "digest")
        self.top = _grow(over, total, [])
        self.root = self.top[-1].first()["root"].hex()


def _below(blocks: DataFrame) -> DataFrame:
    """The paths of all leaves of ``blocks``, which have their own ``path``:
    key, pos, path (per level upwards the digests left and right of it)."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            for row in part.to_pylist():
                rows = block_rows(row["layout"], row["size"], row["block"])
                n = len(rows[0]) // 64
                paths = [[f"{a.decode()}|{b.decode()}" for a, b in siblings(rows, i)] + row["path"] for i in range(n)]
                first = row["block"] * FAN ** LEVELS
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
                     pa.array(paths, pa.list_(pa.string())), pa.array([row["subroot"]] * n, pa.string())],
                    names=["key", "pos", "path", "subroot"])

    return blocks.select("key", "block", "size", "layout", "path", "subroot").mapInArrow(run, "key string, pos long, path array<string>, subroot string")


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256 (of its siblings up
    to the root), folded_root (from ``seen`` and the siblings), verified."""
    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    root = manifest.root

    def run(parts: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for part in parts:
            for row in part.to_pylist():
                rows = block_rows(row["layout"], row["size"], row["block"])
                above = [tuple(p.encode().split(b"|")) for p in row["path"]]
                joined = b"".join(a + b for a, b in above)
                out = []
                for i, (doc_id, seen) in enumerate(zip(row["doc_id"], row["seen"])):
                    inside = siblings(rows, i)
                    node = seen.hex().encode()
                    for a, b in inside:
                        node = hashlib.sha256(a + node + b).hexdigest().encode()
                    for a, b in above:
                        node = hashlib.sha256(a + node + b).hexdigest().encode()
                    proof = hashlib.sha256(b"".join(a + b for a, b in inside) + joined).hexdigest()
                    folded = node.decode()
                    out.append((doc_id, rows[0][i * 64:i * 64 + 64].decode(), row["subroot"], root, proof, folded, folded == root))
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["doc_id", "leaf", "subroot", "root", "proof_sha256",
                                                        "folded_root", "verified"])

    if root is None:
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession().createDataFrame([], schema)
    paths = manifest.top[-1].sparkSession.createDataFrame(
        [("", 0, [], "")], "key string, block long, path array<string>, subroot string")
    for tier in reversed(manifest.top):
        paths = _below(tier.join(paths, ["key", "block"])).withColumnRenamed("pos", "block")
    tops = manifest.groups.join(paths.select(F.col("block").alias("pos"), "path"), "pos") \
        .select("key", F.lit(0).cast("long").alias("block"), "path", F.lower(F.hex("digest")).alias("subroot"), "tier")
    tops = cut(tops)
    last = len(manifest.tiers) - 1
    for n in range(last, -1, -1):
        here = tops.where(F.col("tier") == n).drop("tier")
        known = here if n == last else here.unionByName(paths)
        blocks = manifest.tiers[n].join(known, ["key", "block"])
        if n:
            paths = cut(_below(blocks).withColumnRenamed("pos", "block"))
    return blocks.select("block", "size", "layout", "doc_id", "seen", "path", "subroot").mapInArrow(run, schema)


def verified_documents(docs: DataFrame) -> DataFrame:
    """The manifest's proofs of all documents, held against a copy in which
    every third document's text has lost its capitals."""
    taken = F.pmod(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")), F.lit(3)) == 0
    text = F.when(taken, F.translate(docs["text"], UPPER, UPPER.lower())).otherwise(docs["text"])
    return proofs(Manifest(leaves_of(docs, text=text)))
