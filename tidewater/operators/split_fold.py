"""Ordered folds whose hot keys are spread over tasks.

A greedy packing decides row by row, so it looks sequential; but a closed
batch leaves nothing behind, and the rows after a close do not depend on
what came before it. That splits the fold exactly:

1. Rows are dealt by range of (key, order), so a key with most of all rows
   spans most partitions.
2. Each partition tells two things: the state after its last key, and, for
   the key it begins with, which may have begun earlier, the state after that
   key as a function of the state before it. Such a function is small: only
   rows within one batch of the start can be the first to close, and what
   follows a close is one of few ways on, which soon run together.
3. One row a partition is chained in order: the entry state of each.
4. The same exchange is read again and folded from the entry states.

Nothing runs while a plan is built. Both passes read one exchange (the ranges
are explicit); a partition whose first row is not the one its entry state was
computed for fails the query. Rows that tie in (key, order) go by value.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAR = 1 << 62


def key_starts(rb: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    """First rows of the runs of equal keys, NULL equal to NULL."""
    change = np.zeros(rb.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        code = rb.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change).tolist()


def _values(rb: pa.RecordBatch, values: Sequence[str], a: int, b: int) -> list[np.ndarray]:
    return [rb.column(c).slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in values]


def _name(rb: pa.RecordBatch, columns: Sequence[str], row: int) -> str:
    return repr([rb.column(c)[row].as_py() for c in columns])


# --- rules -------------------------------------------------------------------


class SizeRule:
    """Close before a row when the batch is non-empty and its bytes with the
    row exceed ``limit``; values: len (the row), w (what it adds).

    State: (bytes of the open batch, batch number)."""

    outputs = (T.StructField("batch_no", T.LongType()),)
    fresh = (0, 0)

    def __init__(self, limit: int):
        self.limit = limit

    def step(self, state, ln, w):
        acc, bn = state
        n = len(ln)
        c = np.concatenate(([0], np.cumsum(w)))
        d = c[:-1] + ln  # non-decreasing because w >= len
        out = np.empty(n, dtype=np.int64)
        p, a = 0, acc
        while p < n:
            i_size = int(np.searchsorted(d, self.limit + c[p] - a, side="right"))
            i_pos = int(np.searchsorted(c[:-1], c[p] - a, side="right"))
            i = max(i_size, i_pos, p)
            if i >= n:
                out[p:] = bn
                a = a + int(c[n] - c[p])
                p = n
            else:
                out[p:i] = bn
                bn += 1
                p, a = i, 0
        return (a, bn), [out]

    def unknown(self) -> dict:
        """What is known of a run of rows behind an unknown state: with at
        most ``open`` bytes before it nothing has closed; else the first
        ``above`` that lies below the bytes tells the bytes and closes now."""
        none = np.zeros(0, dtype=np.int64)
        return {"total": 0, "open": FAR, "above": none, "acc": none, "closed": none}

    def feed(self, known: dict, ln, w) -> dict:
        n = len(ln)
        c = np.concatenate(([0], np.cumsum(w)))
        d = c[:-1] + ln
        total, open_ = known["total"], known["open"]
        # The most bytes before the run with which row i does not close yet.
        most = np.maximum(self.limit - total - d, np.where(total + c[:-1] == 0, 0, -1))
        first = np.flatnonzero(most < np.minimum(open_, np.concatenate(([FAR], most[:-1]))))
        begin = np.concatenate([-known["acc"], c[first]])
        ways, way = np.unique(begin, return_inverse=True)
        closes = np.zeros(len(ways), dtype=np.int64)
        live = np.arange(len(ways))
        while len(live):
            at = np.maximum(np.searchsorted(d, self.limit + ways[live], side="right"),
                            np.searchsorted(c[:-1], ways[live], side="right"))
            live, at = live[at < n], at[at < n]
            ways[live] = c[at]
            closes[live] += 1
        above = np.concatenate([known["above"], most[first]])
        acc = (c[n] - ways)[way]
        closed = np.concatenate([known["closed"], np.ones(len(first), dtype=np.int64)]) + closes[way]
        # Neighbours that go on alike are one; the last has the lowest bound.
        last = np.ones(len(acc), dtype=bool)
        last[:-1] = (acc[1:] != acc[:-1]) | (closed[1:] != closed[:-1])
        return {"total": total + int(c[n]), "open": min(open_, int(most[-1])),
                "above": above[last], "acc": acc[last], "closed": closed[last]}

    def after(self, known: dict, state):
        acc, bn = state
        if acc <= known["open"]:
            return acc + known["total"], bn
        k = int(np.flatnonzero(known["above"] < acc)[0])
        return int(known["acc"][k]), bn + int(known["closed"][k])


class TriggerRule:
    """Close after a row when the batch has ``max_lines`` lines or
    ``max_bytes`` bytes, and before a row that comes more than ``gap``
    microseconds after the last; 0 disables. Values: ts_us, len, lines (of
    the row; at least one).

    State: (lines, bytes, time of the last row, batch number)."""

    outputs = (T.StructField("batch_no", T.LongType()), T.StructField("close", T.LongType()))
    fresh = (0, 0, 0, 0)

    def __init__(self, max_lines: int, max_bytes: int, gap: int):
        self.limits, self.gap = (max_lines, max_bytes), gap

    def _parts(self, ts) -> list[tuple[int, int]]:
        gaps = (np.flatnonzero(np.diff(ts) > self.gap) + 1).tolist() if self.gap > 0 else []
        return list(zip([0, *gaps], [*gaps, len(ts)]))

    def _closing(self, sums, p, held) -> list:
        """Per limit the first row whose lines (bytes) reach it, for batches
        that hold ``held`` before row ``p``; FAR without a limit."""
        return [np.searchsorted(c[1:], limit - h + c[p], side="left") if limit > 0 else np.zeros_like(p) + FAR
                for c, limit, h in zip(sums, self.limits, held)]

    def step(self, state, ts, ln, lines):
        cnt, byt, last_ts, bn = state
        n = len(ts)
        bno = np.empty(n, dtype=np.int64)
        trig = np.zeros(n, dtype=np.int64)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (lines, ln)]
        if self.gap > 0 and cnt > 0 and ts[0] - last_ts > self.gap:
            bn, cnt, byt = bn + 1, 0, 0
        for s, e in self._parts(ts):
            if s > 0 and cnt > 0:
                bn, cnt, byt = bn + 1, 0, 0
            p = s
            while p < e:
                i_lines, i_bytes = map(int, self._closing(sums, np.int64(p), (cnt, byt)))
                i = min(i_lines, i_bytes)
                if i < e:
                    bno[p:i + 1] = bn
                    trig[i] = 1 if i == i_lines else 2
                    bn, cnt, byt, p = bn + 1, 0, 0, i + 1
                else:
                    bno[p:e] = bn
                    cnt, byt, p = cnt + int(sums[0][e] - sums[0][p]), byt + int(sums[1][e] - sums[1][p]), e
        return (cnt, byt, int(ts[-1]), bn), [bno, trig]

    def unknown(self) -> dict:
        """Rows that may be the first to close (lines and bytes up to each),
        and for each, as for the first gap, its way on and its closes; a way
        on is the lines and bytes of the open batch."""
        none = np.zeros(0, dtype=np.int64)
        return {"total": (0, 0), "first": None, "last": 0, "sealed": False, "gapped": False, "upto": (none, none),
                "way": none, "closed": none, "held": (none, none)}

    def feed(self, known: dict, ts, ln, lines) -> dict:
        k = dict(known)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (lines, ln)]
        for s, e in self._parts(ts):
            before = k["last"] if s == 0 else ts[s - 1]
            if self.gap > 0 and (s > 0 or k["first"] is not None) and ts[s] - before > self.gap:
                k["closed"] = k["closed"] + (k["held"][0][k["way"]] > 0)
                if not k["sealed"]:
                    k["sealed"] = k["gapped"] = True
                    k["closed"], k["way"] = np.append(k["closed"], 1), np.append(k["way"], 0)
                k["way"], k["held"] = np.zeros_like(k["way"]), (np.zeros(1, np.int64), np.zeros(1, np.int64))
            held = [h.copy() for h in k["held"]]
            p = np.full(len(held[0]), s, dtype=np.int64)
            if not k["sealed"]:
                upto = [t + c[s + 1:e + 1] for t, c in zip(k["total"], sums)]
                full = np.zeros(e - s, dtype=bool)
                for limit, u in zip(self.limits, upto):
                    if limit > 0:
                        full |= u >= limit
                m = (int(np.argmax(full)) + 1 if full.any() else e - s) if max(self.limits) > 0 else 0
                k["sealed"] = bool(full.any())
                k["upto"] = tuple(np.concatenate([a, u[:m]]) for a, u in zip(k["upto"], upto))
                k["way"] = np.concatenate([k["way"], len(p) + np.arange(m)])
                k["closed"] = np.concatenate([k["closed"], np.ones(m, dtype=np.int64)])
                held = [np.concatenate([h, np.zeros(m, dtype=np.int64)]) for h in held]
                p = np.concatenate([p, s + 1 + np.arange(m)])
            closes = np.zeros(len(p), dtype=np.int64)
            live = np.flatnonzero(p < e)
            while len(live):
                i = np.minimum(*self._closing(sums, p[live], [h[live] for h in held]))
                stay, go = live[i >= e], live[i < e]
                for h, c in zip(held, sums):
                    h[stay] += c[e] - c[p[stay]]
                    h[go] = 0
                p[go] = i[i < e] + 1
                closes[go] += 1
                live = go[p[go] < e]
            k["closed"] = k["closed"] + closes[k["way"]]
            if len(p):
                ways, of = np.unique(np.stack(held), axis=1, return_inverse=True)
                held, k["way"] = (ways[0], ways[1]), of.reshape(-1)[k["way"]]
            k["held"] = tuple(held)
        k["first"] = int(ts[0]) if k["first"] is None else k["first"]
        k["total"], k["last"] = tuple(t + int(c[-1]) for t, c in zip(k["total"], sums)), int(ts[-1])
        return k

    def after(self, known: dict, state):
        cnt, byt, last_ts, bn = state
        if self.gap > 0 and cnt > 0 and known["first"] - last_ts > self.gap:
            cnt, byt, bn = 0, 0, bn + 1
        m = len(known["upto"][0])
        i = min([int(np.searchsorted(u, limit - h, side="left"))
                 for u, limit, h in zip(known["upto"], self.limits, (cnt, byt)) if limit > 0], default=m)
        if i >= m and not known["gapped"]:
            return cnt + known["total"][0], byt + known["total"][1], known["last"], bn
        w = known["way"][i]  # the gap comes after the rows that may close
        return int(known["held"][0][w]), int(known["held"][1][w]), known["last"], bn + int(known["closed"][i])


# --- the fold -----------------------------------------------------------------

_TOLD = "_bucket int, _head string, _first string, _last string, _known binary, _exit array<long>"
_ENTRY = "_bucket int, _head string, _entry array<long>"


def split_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], rule,
               keep_values: bool = False) -> DataFrame:
    """Run ``rule`` over each key's rows in order; returns keys, order and
    the rule's outputs, with ``keep_values`` also the values."""
    keys, order, values = list(keys), list(order), list(values)
    cols = list(dict.fromkeys(keys + order + values))
    passed = cols if keep_values else list(dict.fromkeys(keys + order))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The rows travel as one value, so that both passes ask for the same exchange.
    row = F.when(F.monotonically_increasing_id() >= 0, F.struct(*cols)).alias("_row")
    dealt = df.select(row).repartitionByRange(n, *[F.col(f"_row.{c}") for c in keys + order]).select("_row.*") \
        .sortWithinPartitions(*cols)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head = first = last = state = None
        known = rule.unknown()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            starts = [*key_starts(rb, keys), rb.num_rows]
            if head is None:
                head, first = _name(rb, cols, 0), _name(rb, keys, 0)
                last = first
            for a, b in zip(starts[:-1], starts[1:]):
                # Whole keys inside the partition matter to no other one.
                if a > 0 and b < rb.num_rows:
                    continue
                key = _name(rb, keys, a)
                if key == first:
                    known = rule.feed(known, *_values(rb, values, a, b))
                elif b == rb.num_rows:
                    state = rule.step(state if key == last else rule.fresh, *_values(rb, values, a, b))[0]
                last = key
        if head is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([head], pa.string()),
                 pa.array([first], pa.string()), pa.array([last], pa.string()), pa.array([pickle.dumps(known)], pa.binary()),
                 pa.array([state], pa.list_(pa.int64()))],
                names=["_bucket", "_head", "_first", "_last", "_known", "_exit"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                entry = state if r["_first"] == last and state is not None else rule.fresh
                out.append((r["_bucket"], r["_head"], list(entry)))
                last = r["_last"]
                state = r["_exit"] if r["_exit"] is not None else rule.after(pickle.loads(r["_known"]), tuple(entry))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()),
                     pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["_bucket", "_head", "_entry"])

    told = dealt.mapInArrow(tell, _TOLD)
    # One row a range: the number of ranges bounds what is chained and broadcast.
    entries = told.repartition(1).sortWithinPartitions("_bucket").mapInArrow(chain, _ENTRY)
    rows = dealt.withColumn("_bucket", F.spark_partition_id()).join(F.broadcast(entries), "_bucket", "left")
    out_schema = T.StructType([dealt.schema[c] for c in passed] + list(rule.outputs))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            if last is None:
                entry = rb.column("_entry")[0].as_py()
                if rb.column("_head")[0].as_py() != _name(rb, cols, 0):
                    raise RuntimeError("the dealt rows were read in two different ways")
            starts = [*key_starts(rb, keys), rb.num_rows]
            outs: list[list[np.ndarray]] = [[] for _ in rule.outputs]
            for a, b in zip(starts[:-1], starts[1:]):
                key = _name(rb, keys, a) if a == 0 or b == rb.num_rows else None
                if last is None:
                    state = tuple(entry)
                elif key is None or key != last:
                    state = rule.fresh
                last = key or ""
                state, found = rule.step(state, *_values(rb, values, a, b))
                for o, f in zip(outs, found):
                    o.append(f)
            arrays = [rb.column(c) for c in passed]
            arrays += [pa.array(np.concatenate(o), pa.int64()) for o in outs]
            yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)

    return rows.mapInArrow(fold, out_schema)
