"""The table-backed trigger batching job against the batch operator."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import packing
from tidewater.streaming import batching

SCHEMA = "tenant_id string, dataset_id string, seq long, tsec long, size long"


def messages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("tsec").cast("timestamp_ntz")).drop("tsec")


def some(seed, n=900):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, 5, 50, 400])
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["d", "d", "e"]), i, t, rng.choice([0, 1, 50, 300])))
    return rows


def fold(spark, tmp, parts, limits, retry=()):
    state, sink = os.path.join(tmp, "state"), os.path.join(tmp, "sink")
    for n, part in enumerate(parts):
        for _ in range(2 if n in retry else 1):
            batching.batch_micro_batch(messages(spark, part), n, state, sink, *limits)
    schema = messages(spark, parts[0]).schema
    return batching.batches_with_open(spark, state, sink, len(parts) - 1, schema)


def result(df):
    return sorted(((r.tenant_id, r.dataset_id, r.batch_no, r.messages, r.bytes, r.first_us, r.last_us, r.trigger_reason)
                   for r in df.collect()), key=repr)


def expected(spark, rows, limits):
    per = packing.pack_by_triggers(messages(spark, rows), max_lines=limits[0], max_bytes=limits[1], timeout_s=limits[2])
    us = [F.unix_micros(F.col(c).cast("timestamp")).alias(a) for c, a in (("first_ts", "first_us"), ("last_ts", "last_us"))]
    return result(per.select("tenant_id", "dataset_id", "batch_no", "messages", "bytes", *us, "trigger_reason"))


@pytest.mark.parametrize("limits", [(7, 900, 100), (0, 900, 0), (5, 0, 0), (0, 0, 300)])
def test_micro_batches_give_what_one_fold_gives(spark, tmpdir_path, limits):
    rows = some(sum(limits))
    cuts = [0, 1, 200, 450, 451, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    assert result(fold(spark, tmpdir_path, parts, limits)) == expected(spark, rows, limits)


def test_a_retried_micro_batch_replaces_its_output(spark, tmpdir_path):
    rows = some(3, 300)
    parts = [rows[:100], rows[100:200], rows[200:]]
    assert result(fold(spark, tmpdir_path, parts, (7, 900, 100), retry=(0, 1, 2))) == expected(spark, rows, (7, 900, 100))


def test_silent_keys_keep_their_numbers(spark, tmpdir_path):
    parts = [[("a", "d", 1, 10, 5), ("a", "d", 2, 11, 5), ("b", "d", 3, 11, 5)], [("b", "d", 4, 12, 5)],
             [("a", "d", 5, 13, 5), ("b", "d", 6, 14, 5)]]
    got = result(fold(spark, tmpdir_path, parts, (2, 0, 0)))
    assert [(r[0], r[2], r[3], r[7]) for r in got] == [
        ("a", 0, 2, "line_limit_reached"), ("a", 1, 1, "service_shutdown"),
        ("b", 0, 2, "line_limit_reached"), ("b", 1, 1, "service_shutdown")]


def test_idle_batches_close_by_the_clock(spark, tmpdir_path):
    part = [("a", "d", 1, 10, 5), ("b", "d", 2, 100, 5)]
    fold(spark, tmpdir_path, [part], (9, 0, 60))
    left = batching.open_batches(spark, os.path.join(tmpdir_path, "state"), 0, messages(spark, part).schema)
    closed = batching.close_idle(left, 101_000_000, 60).collect()
    assert [(r.tenant_id, r.messages, r.trigger_reason) for r in closed] == [("a", 1, "timeout")]


def test_a_missing_state_of_an_earlier_batch_fails(spark, tmpdir_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batching.batch_micro_batch(messages(spark, some(1, 5)), 4, tmpdir_path + "/none", tmpdir_path + "/sink", 2)


def test_nothing_stays_cached(spark, tmpdir_path):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    fold(spark, tmpdir_path, [some(1, 50), some(2, 50)], (7, 0, 0))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
