"""Ordered folds against brute-force Python references."""

import random

from pyspark.sql import functions as F

from tidewater.operators import packing


def _brute_size(items, limit):
    """items: (key, order, len, w) -> {(key, order): batch_no}."""
    out, state = {}, {}
    for key, order, ln, w in sorted(items):
        acc, bn = state.get(key, (0, 0))
        if acc > 0 and (acc + ln) // 5 > limit:
            bn, acc = bn + 1, 0
        out[(key, order)] = bn
        state[key] = (acc + w, bn)
    return out


def test_size_packing_matches_brute_force(spark):
    random.seed(3)
    rows = []
    for i in range(3000):
        key = random.choice(["a", "b", "c"])
        size = random.choice([0, 1, 10, 100, 499, 500, 501, 2000, 5000])
        rows.append((key, "ndjson" if key != "c" else "raw", i, size, random.random() < 0.5))
    df = spark.createDataFrame(rows, "tenant_id string, data_hint string, ts long, size long, ends_nl boolean") \
        .withColumn("dataset_id", F.lit("d"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # force keys across Arrow batches
    try:
        got = {(r.tenant_id, r.ts): r.batch_no for r in
               packing.pack_by_size(df, order=["ts"], max_batch_bytes=300).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    items = [(k, ts, s, s + (1 if h == "ndjson" and s > 0 and not nl else 0)) for k, h, ts, s, nl in rows]
    assert got == _brute_size(items, 300)


def test_size_packing_boundaries(spark):
    # limit 10 => close before an item when (acc + len) // 5 > 10, i.e. acc + len >= 55
    rows = [("t", 1, 100), ("t", 2, 10), ("t", 3, 44), ("t", 4, 1), ("t", 5, 1)]
    df = spark.createDataFrame(rows, "tenant_id string, ts long, size long").withColumn(
        "dataset_id", F.lit("d")).withColumn("data_hint", F.lit("raw"))
    got = [r.batch_no for r in packing.pack_by_size(df, order=["ts"], ends_nl=None, max_batch_bytes=10)
           .orderBy("ts").collect()]
    # 100 alone (oversize, first item); 10 + 44 = 54 stays (54 // 5 = 10, not > 10); +1 -> 55 closes.
    assert got == [0, 1, 1, 2, 2]


def test_size_packing_newline_byte_counts(spark):
    rows = [("t", 1, 27, False), ("t", 2, 27, False), ("t", 3, 1, True)]
    df = spark.createDataFrame(rows, "tenant_id string, ts long, size long, ends_nl boolean").withColumn(
        "dataset_id", F.lit("d")).withColumn("data_hint", F.lit("ndjson"))
    got = [r.batch_no for r in packing.pack_by_size(df, order=["ts"], max_batch_bytes=10).orderBy("ts").collect()]
    # acc after two items = 56 (two added newlines); 56 + 1 = 57 >= 55 closes before the third.
    assert got == [0, 1, 1]


def _brute_triggers(msgs, max_lines, max_bytes, timeout):
    out, st = [], {}
    for key, ts, seq, size in sorted(msgs):
        cnt, byt, last, bn = st.get(key, (0, 0, None, 0))
        if cnt > 0 and timeout > 0 and ts - last > timeout:
            out.append((key, bn, "timeout"))
            bn, cnt, byt = bn + 1, 0, 0
        cnt, byt, last = cnt + 1, byt + size, ts
        if max_lines and cnt >= max_lines:
            out.append((key, bn, "line_limit_reached")); bn, cnt, byt = bn + 1, 0, 0
        elif max_bytes and byt >= max_bytes:
            out.append((key, bn, "size_limit_reached")); bn, cnt, byt = bn + 1, 0, 0
        st[key] = (cnt, byt, last, bn)
    for key, (cnt, byt, last, bn) in st.items():
        if cnt:
            out.append((key, bn, "service_shutdown"))
    return sorted(out)


def test_trigger_packing_matches_brute_force(spark):
    random.seed(5)
    rows, t = [], {"a": 0, "b": 0}
    for i in range(2000):
        k = random.choice("ab")
        t[k] += random.choice([1, 2, 5, 50, 400])
        rows.append((k, t[k], i, random.randint(1, 300)))
    df = spark.createDataFrame(rows, "tenant_id string, tsec long, seq long, size long").withColumn(
        "dataset_id", F.lit("d")).withColumn("ts", F.timestamp_seconds("tsec").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
    try:
        got = sorted((r.tenant_id, r.batch_no, r.trigger_reason) for r in
                     packing.pack_by_triggers(df, max_lines=7, max_bytes=900, timeout_s=100).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    assert got == _brute_triggers([(k, ts, s, z) for k, ts, s, z in rows], 7, 900, 100)


def test_quota_admission(spark):
    rows = [("t", 1, 60, 10), ("t", 2, 50, 10), ("t", 3, 30, 10), ("t", 4, 1, 10), ("u", 1, 200, 0)]
    df = spark.createDataFrame(rows, "tenant_id string, ts long, size long, current_bytes long").withColumn("seq", F.col("ts"))
    got = [(r.tenant_id, r.ts, r.admitted) for r in
           packing.quota_admission(df, max_bytes=100).orderBy("tenant_id", "ts").collect()]
    # 10+60=70 ok; +50=120 rejected; +30=100 ok; +1=101 rejected; u: 200 > 100 rejected
    assert got == [("t", 1, True), ("t", 2, False), ("t", 3, True), ("t", 4, False), ("u", 1, False)]


def test_size_packing_sub_key_is_opt_in(spark):
    rows = [("t", 1, 0, 30), ("t", 2, 0, 30), ("t", 3, 1, 30), ("t", 4, 1, 30)]
    df = spark.createDataFrame(rows, "tenant_id string, ts long, hour long, size long").withColumn(
        "dataset_id", F.lit("d")).withColumn("data_hint", F.lit("raw"))
    seq = [r.batch_no for r in packing.pack_by_size(df, order=["ts"], ends_nl=None, max_batch_bytes=20)
           .orderBy("ts").collect()]
    split = [(r.hour, r.batch_no) for r in packing.pack_by_size(df, order=["ts"], ends_nl=None, max_batch_bytes=20,
                                                                 sub_key="hour").orderBy("ts").collect()]
    # limit 20 -> close when acc + len >= 105: 30+30+30 = 90 + 30 = 120 closes before the 4th item
    assert seq == [0, 0, 0, 1]
    assert split == [(0, 0), (0, 0), (1, 0), (1, 0)]  # batches restart per sub-key
