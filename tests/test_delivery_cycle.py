"""The delivery cycle job, the batch table, and shipping end to end."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.plans import ingest
from tidewater.sinks import batch_table
from tidewater.streaming import delivery_cycle as cycle

FILES = ("okey long, id string, tenant_id string, dataset_id string, state string, retry_count int, failure_reason string, "
         "trigger_reason string")


def files(spark, rows):
    return spark.createDataFrame([(k, f"f{k}", t, "d", s, n, None, "size_limit_reached") for k, t, s, n in rows], FILES)


def sender(codes, seen):
    """Answers by (file, attempt); files without an answer are not tried."""
    def send(due, number):
        spark = due.sparkSession
        asked = {(r.okey, r.attempt_no) for r in due.collect()}
        seen.append(asked)
        rows = [(k, codes[k][n - 1]) for k, n in sorted(asked) if k in codes and n <= len(codes[k])]
        return spark.createDataFrame(rows, "okey long, status_code int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return send


def brute(codes, first, most):
    """Plain loop over one file: (state, attempts, count)."""
    state, count, used = first
    for code in codes:
        if state == "retry" and count >= most:
            state = "dlq"
        if state not in ("queue", "retry"):
            break
        used += 1
        ok = code is not None and 200 <= code < 300
        hard = code is not None and code in (400, 404)
        if ok:
            state = "delivered"
        elif state == "queue" and hard:
            state, count = "dlq", 0
        elif state == "queue":
            state, count = "retry", 1
        else:
            count += 1
    if state == "retry" and count >= most:
        state = "dlq"
    return state, used, count


def test_cycle_matches_a_loop_over_each_file(spark, tmpdir_path):
    rng = random.Random(2)
    codes = {k: [rng.choice([200, 404, 500, None, 503, 500, 500]) for _ in range(rng.randrange(0, 8))] for k in range(60)}
    rows = [(k, "t", rng.choice(["queue", "retry", "dlq"]), rng.choice([0, 1, 2])) for k in range(60)]
    rows = [(k, t, s, 0 if s == "queue" else n) for k, t, s, n in rows]
    cycle.start(files(spark, rows), tmpdir_path)
    seen = []
    last = cycle.run_cycle(spark, tmpdir_path, sender(codes, seen), max_retries=4)
    got = {r.okey: (r.state, r.attempts_used, r.retry_count) for r in cycle.state_after(spark, tmpdir_path, last).collect()}
    assert got == {k: brute(codes[k], (s, n, 0), 4) for k, _, s, n in rows}
    done = {k for k, (s, *_) in got.items() if s == "delivered"}
    for k in done:  # a delivered file is not asked for again
        assert sum((k, n) in asked for asked in seen for n in range(1, 9)) <= len(codes[k])


def test_a_stopped_cycle_goes_on_and_a_pass_may_run_again(spark, tmpdir_path):
    codes = {1: [500, 500, 200], 2: [404], 3: [500, 500, 500, 500]}
    cycle.start(files(spark, [(1, "t", "queue", 0), (2, "t", "queue", 0), (3, "t", "queue", 0)]), tmpdir_path)
    assert cycle.run_cycle(spark, tmpdir_path, sender(codes, []), max_retries=3, most_passes=1) == 1
    cycle.run_pass(spark, tmpdir_path, 1, sender(codes, []), max_retries=3)
    last = cycle.run_cycle(spark, tmpdir_path, sender(codes, []), max_retries=3)
    got = {r.okey: (r.state, r.attempts_used, r.retry_count, r.failure_reason) for r in cycle.state_after(spark, tmpdir_path, last).collect()}
    assert got[1][:3] == ("delivered", 3, 2)
    assert got[2] == ("dlq", 1, 0, "receiver answered 404: no response body")
    assert got[3] == ("dlq", 3, 3, "max_retries_exceeded")


def test_inactive_tenants_are_not_asked_for(spark, tmpdir_path):
    cycle.start(files(spark, [(1, "off", "queue", 0), (2, "on", "queue", 0)]), tmpdir_path)
    tenants = spark.createDataFrame([("off", 200, False), ("on", 200, True)], "tenant_id string, status_code int, active boolean")
    seen = []
    last = cycle.run_cycle(spark, tmpdir_path, sender({1: [200], 2: [200]}, seen), tenants)
    got = {r.okey: r.state for r in cycle.state_after(spark, tmpdir_path, last).collect()}
    assert got == {1: "dlq", 2: "delivered"} and seen[0] == {(2, 1)}


def test_a_silent_receiver_ends_the_cycle(spark, tmpdir_path):
    cycle.start(files(spark, [(1, "t", "queue", 0)]), tmpdir_path)
    assert cycle.run_cycle(spark, tmpdir_path, sender({}, [])) == 1


LINES = "tenant_id string, dataset_id string, data_hint string, batch_no long, seq long, line_no int, line string, nanos long"


def test_batch_table_round_trip(spark, tmpdir_path):
    rng = random.Random(1)
    texts = ["", "  ", "plain", "ünï çode 日本", "x" * 200_000, "tab\tand\rcr"]
    rows = [("t", rng.choice("de"), "ndjson", rng.randrange(3), i, 0, rng.choice(texts), 1000 + i) for i in range(200)]
    path = os.path.join(tmpdir_path, "b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        batch_table.write_batch_table(batch_table.compress_batches(spark.createDataFrame(rows, LINES)), path)
        back = batch_table.scan_batch_table(spark, path).orderBy("id", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    want = {}
    for t, d, h, b, i, _, x, n in rows:
        want.setdefault((d, b), []).append((i, x, n))
    stored = {(r.dataset_id, r.batch_no): r for r in spark.read.parquet(path).collect()}
    assert stored.keys() == want.keys()
    for k, lines in want.items():
        r = stored[k]
        assert r.line_count == sum(bool(x.strip()) for _, x, _ in lines) and r.first_nanos == min(n for *_, n in lines)
        assert r.total_bytes == sum(len(x.encode()) + 1 for _, x, _ in lines) and r.compressed_bytes == len(r.data)
        assert bytes(r.data[:2]) == b"\x1f\x8b" and r.filename == f"t--{k[0]}--{r.first_nanos}--ndjson.gz"
        assert [b.value for b in back if b.id == r.id] == [x for _, x, _ in sorted(lines)]


def test_one_file_holds_many_batches(spark, tmpdir_path):
    rows = [("t", "d", "raw", b, b, 0, "line", 5 + b) for b in range(300)]
    path = os.path.join(tmpdir_path, "m")
    batch_table.write_batch_table(batch_table.compress_batches(spark.createDataFrame(rows, LINES)), path)
    found = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert spark.read.parquet(path).count() == 300 and len(found) <= 16


def test_empty_table_ships_nothing(spark):
    assert batch_table.compress_batches(spark.createDataFrame([], LINES)).collect() == []


@pytest.mark.parametrize("limit", [10, 100_000])
def test_ship_keeps_every_line(spark, tmpdir_path, limit):
    rows = [(i, "in", "auto", f"t{i % 2}", "d", f'{{"k": {i}}}' if i % 3 else f"text {i}\nmore", "ndjson") for i in range(90)]
    m = spark.createDataFrame(rows, "seq long, input string, data_format string, tenant_id string, dataset_id string, data string, data_hint string") \
        .withColumn("ts", F.timestamp_seconds(F.col("seq")).cast("timestamp_ntz"))
    path = os.path.join(tmpdir_path, "s")
    made = ingest.ship(m, path, "https://recv.example", "g", limit).collect()
    landed = ingest.land_lines(m).select(F.coalesce("stamped", "out").alias("line")).collect()
    back = batch_table.scan_batch_table(spark, path).collect()
    assert sorted(r.value for r in back) == sorted(r.line for r in landed)
    assert sum(r.line_count for r in made) == len(landed) and {r.url for r in made} == {f"https://recv.example/t{i}/d" for i in (0, 1)}
    assert (len(made) > 10) == (limit == 10)
