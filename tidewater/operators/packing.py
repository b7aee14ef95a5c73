"""Ordered folds: size-bounded batch packing, trigger batching, quotas.

Each decision depends on the rows before it, so these are the one place where
Python runs over rows, in numpy and on a *narrow* projection (keys, order
columns, sizes); payloads never enter Python. Size and trigger packing run
through ``split_fold``, which spreads a hot key over tasks exactly: a closed
batch leaves nothing behind. The assignment (keys, order, batch_no) is joined
back to the payload table when the payload is needed (``SNK-03``).

Quotas have no such reset. Everything a tenant writes before its quota first
overflows is admitted by running sums, and what does not fit the room left
then never will; only the writes that might still fit are folded one after
the other (``ordered_fold``: one task a tenant, in constant memory).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LINE_BASED_HINTS
from ..plans.prefix import exclusive_running_sum
from .split_fold import SizeRule, TriggerRule, key_starts, split_fold

# Default batch limit and the assumed compression ratio.
DEFAULT_MAX_BATCH_BYTES = 9 * 1024 * 1024
COMPRESSION_RATIO = 5


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    step: Callable[[object, dict[str, np.ndarray]], tuple[object, dict[str, np.ndarray]]],
    init: Callable[[], object],
    out_fields: Sequence[T.StructField],
    keep_values: bool = False,
) -> DataFrame:
    """Run ``step`` over each key's rows in order, a key in one task; returns
    keys, order and the step's output columns.

    ``step(state, arrays) -> (state, outputs)`` is called with the arrays
    of one contiguous run of a key (a key can span several Arrow batches;
    its state is carried across them). ``keep_values`` also returns the
    (narrow) value columns, so callers that only aggregate need no join.
    """
    keys, order, values = list(keys), list(order), list(values)
    narrow = df.select(*keys, *order, *values)
    in_schema = narrow.schema
    passed = keys + order + (values if keep_values else [])
    out_schema = T.StructType([in_schema[c] for c in passed] + list(out_fields))
    arrow_out = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out_schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur_key = None
        state = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            vals = {c: rb.column(c).to_numpy(zero_copy_only=False) for c in values}
            starts = [*key_starts(rb, keys), rb.num_rows]
            outs: dict[str, list[np.ndarray]] = {f.name: [] for f in out_fields}
            for a, b in zip(starts[:-1], starts[1:]):
                k = tuple(rb.column(c)[a].as_py() for c in keys)
                if k != cur_key:
                    cur_key, state = k, init()
                state, o = step(state, {c: v[a:b] for c, v in vals.items()})
                for name, arr in o.items():
                    outs[name].append(arr)
            cols = [rb.column(c) for c in passed]
            cols += [pa.array(np.concatenate(outs[f.name]), type=_arrow_type(f.dataType)) for f in out_fields]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_out)

    parts = narrow.repartition(*keys).sortWithinPartitions(*keys, *order)
    return parts.mapInArrow(run, out_schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    m = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
         T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.TimestampNTZType: pa.timestamp("us"),
         T.TimestampType: pa.timestamp("us", tz="UTC"), T.DateType: pa.date32(), T.ShortType: pa.int16()}
    for k, v in m.items():
        if isinstance(t, k):
            return v
    raise TypeError(f"unsupported fold column type {t}")


# --- PAK-01: greedy size packing -------------------------------------------------


def pack_by_size(
    raw: DataFrame,
    keys: Sequence[str] = ("tenant_id", "dataset_id", "data_hint"),
    order: Sequence[str] = ("ts",),
    size: str = "size",
    ends_nl: str | None = "ends_nl",
    hint: str = "data_hint",
    max_batch_bytes: int = DEFAULT_MAX_BATCH_BYTES,
    keep_sizes: bool = False,
    sub_key: str | None = None,
) -> DataFrame:
    """PAK-01: greedy size packing per key in file order.

    Before adding a file, the batch is closed when it is non-empty and the
    estimated compressed size ``(acc + len) // 5`` exceeds the limit. For
    line-based hints a missing final newline adds one byte to the batch.
    Returns keys, order columns and ``batch_no`` (0-based per key); with
    ``keep_sizes`` also ``len`` and ``w`` (bytes the file adds to its batch).

    ``sub_key`` (opt-in, off by default) adds a column such as the hour of
    the file to the key: a hot dataset then folds in parallel per sub-key,
    at the price that no batch spans two sub-keys (batch boundaries differ
    from the sequential rule, which is why it is not the default).
    """
    limit = max_batch_bytes if max_batch_bytes > 0 else DEFAULT_MAX_BATCH_BYTES
    add_nl = F.col(hint).isin(*LINE_BASED_HINTS) & (F.col(size) > 0)
    if ends_nl:
        add_nl = add_nl & ~F.col(ends_nl)
    d = raw.withColumn("len", F.col(size).cast("long")).withColumn(
        "w", F.col(size).cast("long") + F.when(add_nl, 1).otherwise(0))
    fold_keys = list(keys) + ([sub_key] if sub_key else [])
    rule = SizeRule(COMPRESSION_RATIO * limit + COMPRESSION_RATIO - 1)
    return split_fold(d, fold_keys, order, ["len", "w"], rule, keep_values=keep_sizes)


# --- PAK-02: trigger packing ------------------------------------------------------


def pack_by_triggers(
    messages: DataFrame,
    keys: Sequence[str] = ("tenant_id", "dataset_id"),
    order: Sequence[str] = ("ts", "seq"),
    ts: str = "ts",
    size: str = "size",
    max_lines: int = 0,
    max_bytes: int = 0,
    timeout_s: int = 0,
) -> DataFrame:
    """PAK-02: count / byte / idle triggers per (tenant, dataset).

    After adding a message the batch closes when its count reaches
    ``max_lines`` (``line_limit_reached``) or its bytes reach ``max_bytes``
    (``size_limit_reached``); a gap longer than ``timeout_s`` since the last
    message closes the open batch (``timeout``); what is open at the end is
    flushed (``service_shutdown``). Zero disables a trigger. Returns one row
    per batch: keys, batch_no, messages, bytes, first/last ts, trigger.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = messages.select(*keys, *order, us.alias("ts_us"), us.alias("first_us"), F.col(size).cast("long").alias("len"),
                        F.lit(1).cast("long").alias("lines"))
    per = batches_of(d, keys, order, TriggerRule(max_lines, max_bytes, int(timeout_s) * 1_000_000))
    ts_type = messages.schema[ts].dataType.simpleString()
    return per.select(*keys, "batch_no", "messages", "bytes",
                      F.timestamp_micros("first_us").cast(ts_type).alias("first_ts"),
                      F.timestamp_micros("last_us").cast(ts_type).alias("last_ts"),
                      F.coalesce("trigger_reason", F.lit("service_shutdown")).alias("trigger_reason"))


def batches_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rule: TriggerRule) -> DataFrame:
    """One row per batch of ``rows`` (keys, order, ts_us, first_us, len,
    lines): keys, batch_no, messages, bytes, first_us, last_us and
    trigger_reason, NULL for the batch of each key that is still open."""
    told = split_fold(rows, keys, order, ["ts_us", "len", "lines", "first_us"], _Narrow(rule), keep_values=True)
    per = told.groupBy(*keys, "batch_no").agg(
        F.sum("lines").cast("long").alias("messages"), F.sum("len").cast("long").alias("bytes"),
        F.min("first_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max("close").alias("close"))
    # A batch not closed by count or bytes was closed by the idle gap before
    # the next batch of its key, or is the last and open.
    on = F.col("batch_no") == F.col("_no")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    nxt = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("batch_no") - 1).alias("_no"),
                     F.lit(True).alias("has_next"))
    reason = (F.when(F.col("close") == 1, F.lit("line_limit_reached"))
              .when(F.col("close") == 2, F.lit("size_limit_reached"))
              .when(F.col("has_next"), F.lit("timeout")))
    return per.join(nxt, on, "left").select(*keys, "batch_no", "messages", "bytes", "first_us", "last_us",
                                            reason.alias("trigger_reason"))


class _Narrow:
    """A trigger rule that takes the first time along without reading it."""

    def __init__(self, rule: TriggerRule):
        self.rule, self.outputs, self.fresh = rule, rule.outputs, rule.fresh
        self.unknown, self.after = rule.unknown, rule.after

    def step(self, state, ts, ln, lines, first):
        return self.rule.step(state, ts, ln, lines)

    def feed(self, known, ts, ln, lines, first):
        return self.rule.feed(known, ts, ln, lines)


# --- PAK-03: quota admission ------------------------------------------------------


def _quota_step(cap: int):
    """Rows that may still fit, from the bytes admitted before the first."""

    def step(state, v):
        sz, base = v["size"].astype(np.int64), v["current"].astype(np.int64)
        used = int(v["used"][0]) if state is None else state
        n = len(sz)
        ok = np.zeros(n, dtype=bool)
        c = np.concatenate(([0], np.cumsum(sz)))
        need = base + sz
        # Least need from each row on: with less room nothing fits any more.
        least = np.minimum.accumulate(need[::-1])[::-1]

        def next_fit(p: int, room: int) -> int:
            """The first row from p on that fits the room, in growing looks."""
            look = 64
            while p < n and least[p] <= room:
                hit = np.flatnonzero(need[p:p + look] <= room)
                if len(hit):
                    return p + int(hit[0])
                p, look = p + look, look * 2
            return n

        # need + bytes admitted in a row of admissions, for a searchsorted
        # when all rows start from the same size.
        flat = bool((base == base[0]).all())
        p = 0
        while p < n:
            p = next_fit(p, cap - used)
            if p >= n:
                break
            i = int(np.searchsorted(c[1:], cap - used - int(base[p]) + c[p], side="right")) if flat else p + 1
            i = max(i, p + 1)
            ok[p:i] = True
            used += int(c[i] - c[p])
            p = i
        return used, {"admitted": ok}

    return step


def quota_admission(
    writes: DataFrame,
    keys: Sequence[str] = ("tenant_id",),
    order: Sequence[str] = ("ts", "seq"),
    size: str = "size",
    current: str = "current_bytes",
    max_bytes: int = 0,
) -> DataFrame:
    """PAK-03: admit a write iff current + admitted-so-far + size <= max.

    ``current`` is the size already on disk for the key (after cleanup);
    only admitted writes accumulate. Returns keys, order and ``admitted``.
    """
    keys, order, cap = list(keys), list(order), int(max_bytes)
    d = writes.select(*keys, *order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
                      F.coalesce(F.col(current).cast("long"), F.lit(0)).alias("current"))
    alone = F.col("current") + F.col("size") <= cap
    # Writes above the cap by themselves are out, and take nothing.
    offered = exclusive_running_sum(d.withColumn("_take", F.when(alone, F.col("size")).otherwise(0)), "_take", keys, order, "used") \
        .drop("_take")
    over = alone & (F.col("current") + F.col("used") + F.col("size") > cap)
    at = F.struct(*order)
    firsts = offered.where(over).groupBy(*keys).agg(F.min(F.struct(at.alias("at"), "used")).alias("_over"))
    firsts = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_over")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    told = offered.join(firsts, same, "left").drop(*[f"_k{i}" for i in range(len(keys))]) \
        .withColumn("_late", F.coalesce(at > F.col("_over.at"), F.lit(False))) \
        .withColumn("_may", F.col("_late") & (F.col("current") + F.col("_over.used") + F.col("size") <= cap))
    early = told.where(~F.col("_may")).select(*keys, *order, (alone & ~over & ~F.col("_late")).alias("admitted"))
    late = ordered_fold(told.where("_may").withColumn("used", F.col("_over.used")), keys, order, ["size", "current", "used"],
                        _quota_step(cap), lambda: None, [T.StructField("admitted", T.BooleanType())])
    return early.unionByName(late)
