"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a string of bits, the sides of hyperplanes on its
way down; rows whose strings share a long prefix are near each other. A query
descends in every tree to its longest prefix match and then ascends all trees
together, one bit at a time, until the matches of the shortened prefixes hold
enough candidates. Those are scored with exact inner products in double
precision.

* Hyperplanes are fitted on a bounded sample (``Settings.sample`` distinct
  vectors) with median splits, so prefixes of one length hold about equally
  many rows. Every row is indexed.
* How many candidates are enough is calibrated, not guessed: the exact
  neighbours of ``Settings.calibrate`` queries are found by scanning all rows,
  and the smallest number is taken with which the forest finds
  ``Settings.recall`` of them. Without structure in the data that comes near
  a full scan; the recall is kept.
* Prefix counts of the fitted strings (a table bounded by the forest) tell
  each query its stopping level before anything is shuffled. Rows and queries
  then meet by (tree, prefix). Inside, strings are a sorted array and a prefix
  is a range of it. A prefix with many rows is dealt into blocks of about
  ``Settings.block`` rows and its queries into blocks of about
  ``Settings.ask_block``; every pair of them is one group.
* Equal vectors are one entry that carries its smallest ids, as many as a
  result can hold, so copies cost one vector.

Defined results: vectors that are NULL, zero or hold NULL or non-finite
components take no part, nor do those whose length is not the most common
one (the shorter on ties) and rows without an id; rows with the same id and
vector are one; ties go to the smaller vec_id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


@dataclass(frozen=True)
class Settings:
    trees: int = 12
    sample: int = 32_768
    most_bits: int = 12
    least_leaf: int = 128
    calibrate: int = 128
    recall: float = 0.95
    block: int = 16_384
    ask_block: int = 65_536
    seed: int = 3


class Forest:
    """Fitted trees: node k of a level splits at ``plane . x > bound``."""

    def __init__(self, x, trees: int, bits: int, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.bits, self.trees = bits, trees
        dim = x.shape[1]
        self.planes = np.zeros((trees, (1 << bits) - 1, dim))
        self.bounds = np.zeros((trees, (1 << bits) - 1))
        for t in range(trees):
            groups = [np.arange(len(x))]
            for node in range((1 << bits) - 1):
                rows = groups[node]
                plane = rng.normal(size=dim)
                if len(rows) >= 2:
                    # Towards the two halves' centres, from a random start.
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    for _ in range(2):
                        if not (a != b).any():
                            break
                        plane = a - b
                        side = x[rows] @ plane
                        high = side > np.median(side)
                        if not high.any():
                            break
                        a, b = x[rows[high]].mean(axis=0), x[rows[~high]].mean(axis=0)
                side = x[rows] @ plane
                bound = float(np.median(side)) if len(rows) else 0.0
                self.planes[t, node], self.bounds[t, node] = plane, bound
                groups += [rows[side <= bound], rows[side > bound]]
                groups[node] = None

    def codes(self, x):
        """The strings of each vector, one a tree, as numbers of ``bits`` bits."""
        import numpy as np

        out = np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            code = np.zeros(len(x), dtype=np.int64)
            for level in range(self.bits):
                node = code + (1 << level) - 1
                side = np.einsum("ij,ij->i", self.planes[t][node], x) > self.bounds[t][node]
                code = (code << 1) | side
            out[:, t] = code
        return out


def _stops(codes, counts, bits: int, enough: float):
    """Per query the longest common prefix length at which all trees together
    hold ``enough`` rows; 0 takes everything."""
    import numpy as np

    stop = np.zeros(len(codes), dtype=np.int64)
    open_ = np.ones(len(codes), dtype=bool)
    for level in range(bits, 0, -1):
        held = np.zeros(len(codes))
        for t in range(codes.shape[1]):
            held += counts[t][level][codes[:, t] >> (bits - level)]
        hit = open_ & (held >= enough)
        stop[hit] = level
        open_ &= ~hit
    return stop


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(id, vec) of the usable rows, the components as raw bytes."""
    kind = vectors.schema[vec_col].dataType.elementType
    code = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    col = F.col(vec_col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in parts:
            ids, vecs = [], []
            for i, v in zip(part.column("id").to_pylist(), part.column("vec")):
                values = v.values
                if values is None or values.null_count or i is None:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(code)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "vec"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), col.alias("vec"))
    return narrow.mapInArrow(run, "id long, vec binary"), code


def _matrix(column, code: str):
    import numpy as np

    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), code).astype(np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def search(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           settings: Settings = Settings()) -> DataFrame:
    """The ``k`` nearest rows by inner product of each row that ``queries``
    (a condition on ``id``) holds for: query_id, rank, vec_id, score."""
    s = settings
    packed, code = _packed(vectors, id_col, vec_col)
    usable = cut(packed)
    schema = "query_id long, rank int, vec_id long, score double"
    common = usable.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    usable = usable.where(F.length("vec") == common["n"])

    # Equal vectors: one entry, named by its smallest id.
    first = Window.partitionBy("vec").orderBy("id")
    ids = usable.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    members = cut(ids.withColumn("gid", F.min("id").over(Window.partitionBy("vec"))).select("gid", "id", "vec", "nth"))
    entries = members.where("nth = 1").select("gid", "vec")
    asked = cut(usable.where(queries).distinct().join(entries, "vec").select("id", "gid"))
    wanted = asked.select("gid").distinct()
    total = entries.count()

    sampled = entries.orderBy(F.xxhash64("gid", F.lit(s.seed)), "gid").limit(s.sample).toArrow()
    sample = _matrix(sampled.column("vec").combine_chunks(), code)
    bits = max(0, min(s.most_bits, (len(sample) // s.least_leaf).bit_length() - 1))
    forest = Forest(sample, s.trees, bits, s.seed)
    held = _leaf_counts(entries, forest, code)
    enough = _calibrated(entries, wanted, forest, held, code, k, total, s)

    # Index rows and queries, keyed by tree and the shortest prefix in use.
    def routed(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in parts:
            codes = forest.codes(_matrix(part.column("vec"), code))
            stops = _stops(codes, held, bits, enough)
            n = len(codes)
            at = np.repeat(np.arange(n), s.trees)
            taken = pa.RecordBatch.from_arrays(
                [part.column("gid"), part.column("vec")], names=["gid", "vec"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [taken.column("gid"), taken.column("vec"), pa.array(np.tile(np.arange(s.trees), n), pa.int32()),
                 pa.array(codes.ravel()), pa.array(stops[at], pa.int32())],
                names=["gid", "vec", "tree", "code", "stop"])

    where = "gid long, vec binary, tree int, code long, stop int"
    index = entries.mapInArrow(routed, where)
    probes = cut(wanted.join(entries, "gid").select("gid", "vec").mapInArrow(routed, where))
    shortest, longest = probes.agg(F.min("stop"), F.max("stop")).first()
    if shortest is None:
        return vectors.sparkSession.createDataFrame([], schema)
    # A query that takes everything needs one tree for it.
    probes = probes.where("stop > 0 OR tree = 0")
    index = index if longest else index.where("tree = 0")
    prefix = F.shiftright("code", bits - shortest)
    # A group is a block of rows with a block of queries of one prefix.
    blocks = max(1, -(-total // (s.block << shortest)))
    asking = max(1, -(-wanted.count() // (s.ask_block << shortest)))

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        sides = [F.pmod(F.xxhash64("gid", F.lit(n)), F.lit(n)).cast("int") if own else
                 F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n, own in ((blocks, not asks), (asking, asks))]
        return rows.select("tree", prefix.alias("prefix"), sides[0].alias("block"), F.lit(asks).alias("asks"), "code", "stop",
                           "gid", "vec").select("*", sides[1].alias("ask_block"))

    index, probes = dealt(index, False), dealt(probes, True)
    keep = k + 1

    def score(rows):
        import numpy as np
        import pyarrow as pa

        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        gid, codes = rows.column("gid").to_numpy(), rows.column("code").to_numpy()
        stops = rows.column("stop").to_numpy()
        x = _matrix(rows.column("vec").combine_chunks(), code)
        order = np.flatnonzero(~asks)
        order = order[np.lexsort((gid[order], codes[order]))]
        strings, own, vecs = codes[order], gid[order], x[order]
        out_q, out_g, out_s = [], [], []
        probe = np.flatnonzero(asks)
        top = codes[probe] >> (bits - stops[probe])
        lo = np.searchsorted(strings, top << (bits - stops[probe]), "left")
        hi = np.searchsorted(strings, (top + 1) << (bits - stops[probe]), "left")
        for a, b in {*zip(lo.tolist(), hi.tolist())}:
            if a == b:
                continue
            mine = probe[(lo == a) & (hi == b)]
            for i in range(0, len(mine), 256):
                q = mine[i:i + 256]
                near = x[q] @ vecs[a:b].T
                n = min(keep, b - a)
                bound = -np.partition(-near, n - 1, axis=1)[:, n - 1]
                # All that tie with the last one, then the smallest ids.
                for j, row in enumerate(near):
                    c = np.flatnonzero(row >= bound[j] - 1e-12)
                    exact = (vecs[a + c] * x[q[j]]).sum(axis=1)
                    best = np.lexsort((own[a + c], -exact))[:keep]
                    out_q.append(np.full(len(best), gid[q[j]]))
                    out_g.append(own[a + c[best]])
                    out_s.append(exact[best])
        if not out_q:
            return pa.table({"query": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        return pa.table({"query": np.concatenate(out_q), "gid": np.concatenate(out_g), "score": np.concatenate(out_s)})

    found = index.unionByName(probes).groupBy("tree", "prefix", "block", "ask_block") \
        .applyInArrow(score, "query long, gid long, score double")
    found = found.groupBy("query", "gid").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "gid"))
    found = found.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")
    pairs = asked.withColumnsRenamed({"id": "query_id", "gid": "query"}).join(found, "query") \
        .join(members.select("gid", F.col("id").alias("vec_id")), "gid").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _leaf_counts(entries: DataFrame, forest: Forest, code: str):
    """Rows of every prefix: per tree and level an array. The collected table
    has a row a fitted leaf at most."""
    import numpy as np

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((forest.trees, 1 << forest.bits), dtype=np.int64)
        for part in parts:
            codes = forest.codes(_matrix(part.column("vec"), code))
            for t in range(forest.trees):
                sums[t] += np.bincount(codes[:, t], minlength=1 << forest.bits)
        tree, leaf = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf), pa.array(sums[tree, leaf])],
                                         names=["tree", "leaf", "n"])

    rows = entries.select("vec").mapInArrow(run, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    leaves = np.zeros((forest.trees, 1 << forest.bits), dtype=np.int64)
    for r in rows.collect():
        leaves[r["tree"], r["leaf"]] = r["n"]
    return [[leaf.reshape(1 << level, -1).sum(axis=1) for level in range(forest.bits + 1)] for leaf in leaves]


def _calibrated(entries, wanted, forest, held, code, k, total, s) -> float:
    """The smallest number of candidates with which the forest finds the
    asked share of the exact neighbours of a sample of queries."""
    import numpy as np

    chosen = wanted.orderBy(F.xxhash64("gid", F.lit(s.seed + 1)), "gid").limit(s.calibrate)
    probes = entries.join(F.broadcast(chosen), "gid").select("gid", "vec").toArrow()
    if not probes.num_rows or not forest.bits:
        return float("inf")
    ids, x = probes.column("gid").to_numpy(), _matrix(probes.column("vec").combine_chunks(), code)

    def scan(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            gid, v = part.column("gid").to_numpy(), _matrix(part.column("vec"), code)
            near = x @ v.T
            near[ids[:, None] == gid[None, :]] = -np.inf
            n = min(k, len(gid))
            best = np.argpartition(-near, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(ids)), n)), pa.array(np.take_along_axis(near, best, 1).ravel()),
                 part.column("vec").take(pa.array(best.ravel()))], names=["q", "score", "vec"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    true = entries.mapInArrow(scan, "q long, score double, vec binary").where("score > double('-infinity')") \
        .withColumn("nth", nth).where(F.col("nth") <= k).select("q", "vec").toArrow()
    if not true.num_rows:
        return float("inf")
    q = true.column("q").to_numpy()
    mine, theirs = forest.codes(x), forest.codes(_matrix(true.column("vec").combine_chunks(), code))
    for level in range(forest.bits, 0, -1):
        enough = forest.trees * total / (1 << level)
        # A level's prefixes hold this many rows or somewhat fewer.
        stops = _stops(mine, held, forest.bits, 0.5 * enough)[q]
        same = ((mine[q] >> (forest.bits - stops)[:, None]) == (theirs >> (forest.bits - stops)[:, None])).any(axis=1)
        if same.mean() >= s.recall:
            return 0.5 * enough
    return float("inf")
