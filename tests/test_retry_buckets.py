"""STR-04 by buckets of files, against a loop over each file."""

import os
import random

from pyspark.sql import functions as F

from tidewater.functions.naming import PERMANENT_CODES
from tidewater.streaming import jobs

ROWS = "okey long, attempt_no int, status_code int"


def loop(codes, most, before=("queue", 0, 0, None)):
    state, used, cnt, code = before
    for c in codes:
        if state in ("delivered", "dlq"):
            break
        good = c is not None and 200 <= c < 300
        hard = c is not None and not good and (c in PERMANENT_CODES or (400 <= c < 500 and c != 429))
        used, code = used + 1, c
        if state == "queue":
            state, cnt = ("delivered", 0) if good else ("dlq", 0) if hard else ("retry", 1)
        elif good:
            state = "delivered"
        else:
            cnt += 1
        if state == "retry" and cnt >= most:
            state = "dlq"
    return state, used, cnt, code


def test_buckets_match_a_loop_over_each_file(spark, tmpdir_path):
    """Three micro-batches; keys beyond doubles' precision and a NULL key."""
    jobs.prepare_streaming(spark)
    rng = random.Random(4)
    keys = [None, 0, -5, 1 << 60, (1 << 60) + 1, *range(1, 60)]
    source, want, state = os.path.join(tmpdir_path, "src"), [], {}
    nth = dict.fromkeys(keys, 0)
    for b in range(3):
        rows = []
        for k in rng.sample(keys, 50):
            codes = [rng.choice([200, 404, 500, None, 503, 429, 299, 418]) for _ in range(rng.randrange(1, 5))]
            rows += [(k, nth[k] + i, c) for i, c in enumerate(codes)]
            nth[k] += len(codes)
            state[k] = loop(codes, 3, state.get(k, ("queue", 0, 0, None)))
            want.append((k, *state[k]))
        rng.shuffle(rows)
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    out = os.path.join(tmpdir_path, "out")
    q = (jobs.retry_state_stream(stream, 3, buckets=4).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "_c").trigger(availableNow=True).start())
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("okey", "state", "attempts_used", "retry_count", "last_code").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_group_of_the_stream_is_a_bucket(spark):
    """Calls of the processor go by buckets, not by files."""
    jobs.prepare_streaming(spark)
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("okey"), F.lit(1).alias("attempt_no"), F.lit(200).alias("status_code"))
    plan = jobs.retry_state_stream(stream, 5)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan
