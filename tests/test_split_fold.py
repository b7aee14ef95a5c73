"""The split folds: hot keys over many ranges, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import packing
from tidewater.operators.split_fold import SizeRule, TriggerRule
from test_packing import _brute_triggers


def plain(rule, rows):
    """Row by row through the rule's own step."""
    state, out = rule.fresh, []
    for r in rows:
        state, found = rule.step(state, *[np.array([x]) for x in r])
        out.append([int(f[0]) for f in found])
    return state, out


RULES = [
    (SizeRule(100), lambda rng, t: (s := rng.choice([0, 1, 7, 30, 99, 100, 101, 250]), s + rng.choice([0, 1]))),
    (SizeRule(100), lambda rng, t: (25, 25)),
    (SizeRule(5), lambda rng, t: (0, 0)),
    (TriggerRule(5, 0, 0), lambda rng, t: (t, 3, 1)),
    (TriggerRule(0, 40, 0), lambda rng, t: (t, rng.choice([0, 1, 10, 41]), 1)),
    (TriggerRule(0, 0, 5), lambda rng, t: (t, 1, 1)),
    (TriggerRule(6, 60, 5), lambda rng, t: (t, rng.choice([0, 1, 10, 41]), rng.choice([1, 1, 2, 7]))),
    (TriggerRule(1, 0, 5), lambda rng, t: (t, 1, 1)),
]


@pytest.mark.parametrize("nth", range(len(RULES)))
def test_what_a_run_does_to_an_unknown_state(nth):
    rule, draw = RULES[nth]
    rng = random.Random(nth)
    for _ in range(150):
        t, rows = 0, []
        for _ in range(rng.randrange(2, 40)):
            t += rng.choice([0, 1, 2, 5, 6, 9])
            rows.append(draw(rng, t))
        at = rng.randrange(1, len(rows))
        entry, _ = plain(rule, rows[:at])
        known = rule.unknown()
        cuts = sorted({at, len(rows), *(rng.randrange(at, len(rows)) for _ in range(3))})
        for a, b in zip(cuts, cuts[1:]):
            known = rule.feed(known, *[np.array(c, np.int64) for c in zip(*rows[a:b])])
        assert rule.after(known, entry) == plain(rule, rows)[0]


@pytest.fixture()
def small_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def brute_sizes(items, limit):
    out, state = {}, {}
    for key, order, ln, w in sorted(items, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        acc, bn = state.get(key, (0, 0))
        if acc > 0 and (acc + ln) // 5 > limit:
            bn, acc = bn + 1, 0
        out[(key, order)] = bn
        state[key] = (acc + w, bn)
    return out


@pytest.mark.parametrize("limit", [3, 300, 100_000])
def test_a_key_with_most_rows_is_packed_by_many_tasks(spark, small_parts, limit):
    rng = random.Random(limit)
    rows = [(rng.choice(["hot"] * 8 + [None, "b"]), "raw", i, rng.choice([0, 1, 10, 499, 500, 2000, 5000]), None) for i in range(6000)]
    rows += [(f"k{i}", "ndjson", 10_000 + i, 5, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "tenant_id string, data_hint string, ts long, size long, length string").withColumn(
        "dataset_id", F.lit("d"))
    packed = packing.pack_by_size(df, order=["ts"], ends_nl=None, max_batch_bytes=limit).withColumn("part", F.spark_partition_id())
    got = packed.collect()
    items = [(k, ts, s, s + (h == "ndjson" and s > 0)) for k, h, ts, s, _ in rows]
    assert {(r.tenant_id, r.ts): r.batch_no for r in got} == brute_sizes(items, limit) and len(got) == len(rows)
    hot = [r.part for r in got if r.tenant_id == "hot"]
    assert len(set(hot)) > 10 and max(map(hot.count, set(hot))) < 3 * len(rows) / 23


@pytest.mark.parametrize("limits", [(7, 900, 100), (0, 900, 0), (7, 0, 0), (0, 0, 300), (50, 0, 100), (0, 100_000, 0)])
def test_triggers_of_a_hot_key(spark, small_parts, limits):
    rng = random.Random(9)
    rows, t = [], {"hot": 0, "b": 0}
    for i in range(3000):
        k = rng.choice(["hot"] * 9 + ["b"])
        t[k] += rng.choice([0, 1, 2, 5, 50, 400])
        rows.append((k, t[k], i, rng.choice([0, 1, 50, 300, 2000])))
    df = spark.createDataFrame(rows, "tenant_id string, tsec long, seq long, size long").withColumn(
        "dataset_id", F.lit("d")).withColumn("ts", F.timestamp_seconds("tsec").cast("timestamp_ntz"))
    got = packing.pack_by_triggers(df, max_lines=limits[0], max_bytes=limits[1], timeout_s=limits[2]).collect()
    assert sorted((r.tenant_id, r.batch_no, r.trigger_reason) for r in got) == _brute_triggers(rows, *limits)
    assert sum(r.messages for r in got) == len(rows)


def brute_quota(rows, cap):
    out, used = {}, {}
    for k, ts, size, base in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        ok = base + used.get(k, 0) + size <= cap
        used[k] = used.get(k, 0) + size * ok
        out[(k, ts)] = ok
    return out


@pytest.mark.parametrize("same_base", [True, False])
def test_quota_before_and_after_the_first_overflow(spark, small_parts, same_base):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + [None, "b", "c"]), i, rng.choice([0, 1, 3, 50, 400, 9_000]),
             100 if same_base else rng.choice([0, 100, 3000])) for i in range(4000)]
    df = spark.createDataFrame(rows, "tenant_id string, ts long, size long, current_bytes long").withColumn("seq", F.col("ts"))
    for cap in (0, 99, 5_000, 60_000, 10**9):
        got = {(r.tenant_id, r.ts): r.admitted for r in packing.quota_admission(df, max_bytes=cap).collect()}
        assert got == brute_quota(rows, cap)


def test_both_passes_read_one_exchange_and_build_no_job(spark):
    df = spark.range(1000).select(F.lit("t").alias("tenant_id"), F.lit("d").alias("dataset_id"), F.lit("raw").alias("data_hint"),
                                  F.col("id").alias("ts"), F.lit(10).cast("long").alias("size"))
    packed = packing.pack_by_size(df, order=["ts"], ends_nl=None, max_batch_bytes=10)
    packed.collect()
    assert "ReusedExchange" in packed._jdf.queryExecution().executedPlan().toString()


def test_empty_table_and_missing_sizes(spark):
    df = spark.createDataFrame([("t", "d", "raw", 1, None), ("t", "d", "raw", None, 5)],
                               "tenant_id string, dataset_id string, data_hint string, ts long, size long")
    assert packing.pack_by_size(df.limit(0), order=["ts"], ends_nl=None).count() == 0
    assert [r.batch_no for r in packing.pack_by_size(df, order=["ts"], ends_nl=None).collect()] == [0, 0]
