"""MinHash near-deduplication with bottom-k sketches.

One hash function gives each document the set of its word shingles' hashes;
the ``sketch`` smallest are its sketch. Equal sets are one class from the
start. Inverted lists of retained values generate candidates, the sketch of
the union estimates their similarity, and the full sets decide.

Losing no link. A pair at or above the threshold shares at least ``least``
retained values, except with probability ``MISS``; so it also shares one of
the (retained - least + 1) values that the fewest sketches hold. Only those
are list keys: a passage that many documents share keys few of them. Where
the sketch is the whole set the bound is exact, less what a partner beyond the
sketch may have dropped. A list is split by size steps; documents of similar
size meet in one of them.

No list is expanded into all its pairs. Lists with the same members are one.
A list of many members is dealt into blocks, and each pair of blocks is a unit
of work. A unit first compares sketches, all of its pairs at once, and names
only the members that have a pair left, counting a pair in its most common
list alone. The sets of those members then travel to their units, where exact
intersections of all pairs come from one product of incidence tables; what
comes out is a spanning forest of the links, at most one row a member.

Defined results: NULL and word-less texts have the empty set and no links;
texts shorter than a shingle are one shingle; a NULL doc_id links with
nothing; rows that share a doc_id are one document; ties go to the smaller
doc_id; an empty table gives an empty result; columns besides doc_id and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, keep_rows

SKETCH = 48
MISS = 1e-9
# A block holds so many members, and so many shingles, at most (one member may
# have more).
BLOCK = 1536
BLOCK_SHINGLES = 1 << 20
# Members, or shingles, that one call to Python gets, apart from large units.
ROWS_PER_CALL = 4000
SHINGLES_PER_CALL = 500_000
# Values that more members share are counted by matrix product.
RARE = 8
PIECE_BYTES = 1 << 20


def _mix(x):
    """Scramble unsigned 64-bit numbers (a bijection)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a buffer, without a loop over words.

    A word's hash is a polynomial in an odd base over random values of its
    lower-cased bytes, taken as a difference of prefix sums.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        import numpy as np

        codes = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        codes[65:91] = codes[97:123]
        self.codes = codes
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        import numpy as np

        def powers(base):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            return np.cumprod(p)

        self.up = powers(self.BASE)
        self.down = powers(pow(self.BASE, -1, 1 << 64))

    def hashes(self, buf):
        """(starts, hashes) of the words of a byte array."""
        import numpy as np

        if len(buf) > len(self.up):
            self._powers(max(len(buf), 2 * len(self.up)))
        gap = self.space[buf]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.codes[buf] * self.up[:len(buf)], out=sums[1:])
        return starts, _mix((sums[ends] - sums[starts]) * self.down[starts])


def _pieces(joined: bytes):
    """(start, bytes) of pieces of a few MB, cut at white space."""
    import re

    at = 0
    space = re.compile(rb"[\x20\x09-\x0d]")
    while at < len(joined):
        m = space.search(joined, at + PIECE_BYTES)
        end = m.start() if m else len(joined)
        yield at, joined[at:end]
        at = end


def shingle_sets(texts: list[bytes | None], words: int, hasher: WordHasher) -> list:
    """Sorted distinct shingle hashes of each text."""
    import numpy as np

    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    starts, hashes = [], []
    for at, piece in _pieces(joined):
        s, h = hasher.hashes(np.frombuffer(piece, np.uint8))
        starts.append(s + at)
        hashes.append(h)
    if not starts:
        return [np.zeros(0, np.uint64) for _ in texts]
    starts, h = np.concatenate(starts), np.concatenate(hashes)
    bound = np.append(np.searchsorted(starts, first), len(starts))
    n = max(0, len(h) - words + 1)
    rolled = np.full(n, words, dtype=np.uint64)
    for j in range(words):
        rolled = rolled * np.uint64(WordHasher.BASE) + h[j:j + n]
    rolled = _mix(rolled) >> np.uint64(1)  # signed order is the same then
    out = []
    for s, e in zip(bound[:-1], bound[1:]):
        if e - s >= words:
            out.append(np.unique(rolled[s:e - words + 1]))
        elif e > s:
            x = np.full(1, e - s, dtype=np.uint64)
            for j in range(s, e):
                x = x * np.uint64(WordHasher.BASE) + h[j:j + 1]
            out.append(_mix(x) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(sketch: int, percent: int, miss: float = MISS) -> int:
    """Retained values that a pair at the threshold shares at least, but for
    a chance of ``miss``: each of the union's ``sketch`` smallest values is
    common with probability ``percent`` / 100."""
    p, below = percent / 100, 0.0
    for t in range(sketch + 1):
        below += math.comb(sketch, t) * p ** t * (1 - p) ** (sketch - t)
        if below > miss:
            return max(1, t)
    return sketch


def least_of_whole(n: int, sketch: int, percent: int) -> int:
    """Retained values that a set of ``n`` <= ``sketch`` values shares at
    least with a partner at the threshold. A partner that fits the sketch too
    shares all of the overlap. A larger one drops so many values as it has
    beyond the sketch, the whole overlap's at worst; ``least_shared`` holds
    for it as well."""
    need, least = -(-n * percent // 100), least_shared(sketch, percent)
    for m in range(sketch + 1, n * 100 // percent + 1):
        overlap = -(-(n + m) * percent // (100 + percent))
        need = min(need, max(least, overlap - (m - sketch)))
    return need


def _sketches(docs: DataFrame, words: int, sketch: int) -> DataFrame:
    def run(parts: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        hasher = WordHasher()
        for part in parts:
            for at, texts in tokens.batches(part.column("text")):
                sets = shingle_sets(texts, words, hasher)
                small = [s[:sketch].view(np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(s) for s in small]), pa.int32()),
                    pa.array(np.concatenate(small) if small else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), lists],
                    names=["doc_id", "n_shingles", "class", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, class binary, sketch array<long>")


def _keys(classes: DataFrame, percent: int, sketch: int) -> DataFrame:
    """List memberships (v, pos in the sketch, held: classes that retain v,
    node, n): per class its rarest retained values, as many as the bound asks
    for, without values that no other class holds."""
    least = least_shared(sketch, percent)
    values = classes.select("node", "n", F.posexplode("sketch").alias("pos", "v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("held")).where("held > 1")
    shared = values.join(common, "v")
    mine = Window.partitionBy("node")
    retained = F.least(F.col("n"), F.lit(sketch))
    # Whole sets in the sketch: by their size.
    whole = F.array(*[F.lit(least_of_whole(n, sketch, percent)) for n in range(1, sketch + 1)])
    need = F.when(F.col("n") <= sketch, F.try_element_at(whole, retained.cast("int"))).otherwise(F.lit(least))
    nth = F.row_number().over(mine.orderBy("held", "v")) + retained - F.count(F.lit(1)).over(mine)
    return shared.withColumn("nth", nth).where(F.col("nth") <= retained - need + 1).select("v", "pos", "held", "node", "n")


def _lists(keys: DataFrame, percent: int) -> DataFrame:
    """Memberships of the lists to compare, by value and size step.

    Each class is in its own size step and the next, so that sizes within the
    threshold's ratio share a step; a pair belongs to the larger of its two
    own steps. Of lists with the same members the most common value's is kept.
    """
    own = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    stepped = keys.drop("pos").withColumn("own_step", own) \
        .withColumn("step", F.explode(F.array(F.col("own_step"), F.col("own_step") + 1)))
    same = ["members", "mix", "lo", "hi", "step"]
    kept = stepped.groupBy("v", "step").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.min("node").alias("lo"),
        F.max("node").alias("hi"), F.max("own_step").alias("top"), F.max("held").alias("held"), F.sum("n").alias("shingles")) \
        .where("members > 1 AND lo < hi AND top = step") \
        .groupBy(*same).agg(F.max(F.struct("held", "v", "shingles")).alias("one")) \
        .select("step", "members", F.col("one.v").alias("v"), F.col("one.shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    kept = kept.select("v", "step", blocks.alias("blocks"))
    return stepped.join(kept, ["v", "step"]).select("v", "step", "blocks", "node", "n", "own_step")


def _marked(classes: DataFrame, keys: DataFrame) -> DataFrame:
    """Per node the sketch and, for each of its values, how many classes hold
    it if it is one of the node's keys, else 0."""
    held = keys.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("pos", "held"))).alias("_held"))
    spots = F.sequence(F.lit(0), F.size("sketch") - 1)
    return classes.join(held, "node").select(
        "node", "sketch", F.transform(spots, lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0))).alias("held"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node
    reachable. Alternates large-star and small-star contractions; each round
    is a few hash joins and ends in a written table."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(small.union(low).distinct())
        # Exact sums of hash halves tell whether a round changed anything.
        h = F.xxhash64("u", "v")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _shared_counts(m: int, owner, values):
    """m x m: how many ``values`` two owners share; an owner has a value once."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.concatenate(([True], values[1:] != values[:-1]))
    group = np.cumsum(start) - 1
    times = np.bincount(group)
    # Whole numbers stay exact: float32 holds those below 2 ** 24.
    kind = np.float32 if len(values) < 1 << 24 else np.float64
    count = np.zeros((m, m), dtype=kind)
    few = times[group] <= RARE
    v, o = group[few], owner[few]
    for d in range(1, RARE):
        hit = v[d:] == v[:-d]
        if not hit.any():
            break
        np.add.at(count, (o[d:][hit], o[:-d][hit]), 1)
    count += count.T
    many = ~few
    if many.any():
        col = np.cumsum(times > RARE) - 1
        c, o = col[group[many]], owner[many]
        step = 4096
        for lo in range(0, int(c.max()) + 1, step):
            table = np.zeros((m, step), dtype=kind)
            part = (c >= lo) & (c < lo + step)
            table[o[part], c[part] - lo] = 1
            count += table @ table.T
    return count


def _dealt_units(lists: DataFrame) -> DataFrame:
    """Memberships by unit: a list's block with each of its other blocks.
    Pairs inside a block belong to its unit with the next one (``within``)."""
    one = F.col("blocks") == 1
    return lists.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .where(one | (F.col("block") != F.col("other"))) \
        .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}) \
        .withColumn("unit", F.xxhash64("v", "step", "x", "y")) \
        .withColumn("within", one | ((F.col("block") + 1) % F.col("blocks") == F.col("other"))) \
        .select("unit", "v", "step", "within", "block", "node", "n", "own_step")


def _allowed(node, n, own, step, block, within, percent):
    """Pairs of a unit that belong to it: size, step and blocks."""
    import numpy as np

    low = n * (percent / 100) - 1e-6
    ok = np.greater_equal.outer(n, low)
    ok &= ok.T
    ok &= np.not_equal.outer(node, node)
    ok &= np.maximum.outer(own, own) == step
    ok &= np.not_equal.outer(block, block) | within[:, None]
    return ok


def _open_members(lists: DataFrame, marked: DataFrame, percent: int, sketch: int) -> DataFrame:
    """The memberships by unit that have a pair which the sketches cannot rule
    out and whose most common list this is."""
    least = least_shared(sketch, percent)
    units = _dealt_units(lists)
    full = units.join(marked, "node")
    calls = max(1, lists.count() // ROWS_PER_CALL)

    def compare(rows):
        import numpy as np

        rows = rows.sort_by([(c, "ascending") for c in ("unit", "v", "step")]).combine_chunks()
        unit, v, step, node, n, own, block = (rows.column(c).to_numpy() for c in (
            "unit", "v", "step", "node", "n", "own_step", "block"))
        within = rows.column("within").to_numpy()
        col = rows.column("sketch").combine_chunks()
        held = rows.column("held").combine_chunks().flatten().to_numpy()
        values, at = col.flatten().to_numpy(), col.offsets.to_numpy() - col.offsets.to_numpy()[0]
        lens = np.diff(at)
        keep = np.zeros(len(node), dtype=bool)
        edges = np.flatnonzero((np.diff(unit) != 0) | (np.diff(v) != 0) | (np.diff(step) != 0)) + 1
        for s, e in zip([0, *edges], [*edges, len(unit)]):
            ok = _allowed(node[s:e], n[s:e], own[s:e], step[s], block[s:e], within[s:e], percent)
            if not ok.any():
                continue
            m, vals, marks = e - s, values[at[s]:at[e]], held[at[s]:at[e]]
            owner = np.repeat(np.arange(m), lens[s:e])
            shared = _shared_counts(m, owner, vals)
            whole = lens[s:e] < sketch
            # Whole sets on both sides: the exact bound of the larger one.
            bound = np.ceil(n[s:e] * percent / 100)
            both = whole[:, None] & whole[None, :]
            ok &= np.where(both, (shared >= bound[:, None]) & (shared >= bound[None, :]), shared >= least)
            # Keys that are more common than this list's value.
            mine = marks[vals == v[s]].max()
            better = (marks > mine) | ((marks == mine) & (vals > v[s]))
            if better.any():
                ok &= _shared_counts(m, owner[better], vals[better]) == 0
            keep[s:e] = ok.any(axis=1)
        return rows.filter(keep).select(["unit", "v", "step", "within", "block", "node", "n", "own_step"])

    return full.withColumn("call", F.pmod(F.xxhash64("unit"), F.lit(calls))).groupBy("call").applyInArrow(
        compare, "unit long, v long, step int, within boolean, block int, node long, n long, own_step int")


def _sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the full shingle sets of ``nodes``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    used = narrow.join(nodes.hint("shuffle_hash"), "node", "left_semi")

    def sets(parts: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = WordHasher()
        for part in parts:
            for at, texts in tokens.batches(part.column("text")):
                found = [s.tobytes() for s in shingle_sets(texts, words, hasher)]
                yield pa.RecordBatch.from_arrays([part.column("node").slice(at, len(texts)), pa.array(found, pa.binary())],
                                                 names=["node", "hashes"])

    return used.mapInArrow(sets, "node long, hashes binary")


def _links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the exact links within each unit."""
    calls = max(1, (members.agg(F.sum("n")).first()[0] or 0) // SHINGLES_PER_CALL)
    full = members.join(_sets_of(docs, members.select("node").distinct(), words), "node")

    def check(rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by([(c, "ascending") for c in ("unit", "v", "step", "node")]).combine_chunks()
        unit, v, step, node, n, own, block = (rows.column(c).to_numpy() for c in (
            "unit", "v", "step", "node", "n", "own_step", "block"))
        within, raw = rows.column("within").to_numpy(), rows.column("hashes")
        out = []
        edges = np.flatnonzero((np.diff(unit) != 0) | (np.diff(v) != 0) | (np.diff(step) != 0)) + 1
        for s, e in zip([0, *edges], [*edges, len(unit)]):
            sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(s, e)]
            sizes = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(e - s), sizes)
            same = _shared_counts(e - s, owner, np.concatenate(sets))
            # 100 * same >= percent * (sum of sizes - same), in whole numbers.
            linked = same.astype(np.float64) * (100 + percent) >= np.add.outer(percent * sizes, percent * sizes)
            linked &= _allowed(node[s:e], n[s:e], own[s:e], step[s], block[s:e], within[s:e], percent)
            # Rows that share a doc_id are one document.
            linked |= np.equal.outer(node[s:e], node[s:e])
            label = np.arange(e - s)
            while True:
                low = np.where(linked, label[None, :], e - s).min(axis=1)
                low = np.minimum(low, low[low])
                if (low == label).all():
                    break
                label = low
            far = label != np.arange(e - s)
            out.append((node[s:e][label[far]], node[s:e][far]))
        a, b = (np.concatenate(c) for c in zip(*out))
        return pa.table({"a": a, "b": b})

    return full.withColumn("call", F.pmod(F.xxhash64("unit"), F.lit(calls))).groupBy("call") \
        .applyInArrow(check, "a long, b long").where("a <> b")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents
    with a Jaccard similarity of ``percent`` / 100 or more are linked."""
    made = cut(_sketches(docs, words, sketch))
    classes = cut(made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class")
                  .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    keys = cut(_keys(classes, percent, sketch))
    lists = cut(_lists(keys, percent))
    members = cut(_open_members(lists, _marked(classes, keys), percent, sketch))
    groups = components(_links(docs, members, words, percent))

    nodes = classes.select("class", "node")
    return made.join(nodes, "class", "left").join(groups, "node", "left") \
        .withColumn("component_id", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id"))
                    .otherwise(F.coalesce("component", "node"))) \
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """One document of each group of near copies; all columns stay."""
    return keep_rows(docs, near_groups(docs, words, percent, sketch).where("kept").select("doc_id"))
