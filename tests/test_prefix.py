"""Ordered prefixes: NULL keys, NULL order values, hot keys, one exchange."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.plans import prefix


def rows(seed=0, n=400):
    rng = random.Random(seed)
    out = [(rng.choice([None, "a", "hot", "hot", "hot"]), rng.choice([None, 1, 1, 2, 3]), i, rng.choice([None, 1, 5])) for i in range(n)]
    return out, "k string, t int, id int, v int"


def expected(data, descending=False):
    """Row id -> rows before it in its key, in order."""
    out = {}
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: ((r[1] is not None, r[1] or 0), r[2]), reverse=descending)
        for i, r in enumerate(mine):
            out[r[2]] = mine[:i]
    return out


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_keep_nulls(spark, descending):
    data, schema = rows()
    df = spark.createDataFrame(data, schema)
    got = prefix.running_sums(df, {"s": F.col("v"), "n": F.lit(1)}, ["k"], ["t", "id"], inclusive=False, descending=descending)
    assert got.columns == ["k", "t", "id", "v", "s", "n"]
    before = expected(data, descending)
    res = got.collect()
    assert len(res) == len(data)
    for r in res:
        assert (r.n, r.s) == (len(before[r.id]), sum(x[3] or 0 for x in before[r.id]))


def test_previous_and_last_values(spark):
    data, schema = rows(1)
    df = spark.createDataFrame(data, schema)
    before = expected(data)
    for r in prefix.previous_value(df, F.col("v"), ["k"], ["t", "id"], "p").collect():
        assert r.p == (before[r.id][-1][3] if before[r.id] else None)
    for r in prefix.last_non_null(df, F.col("v"), ["k"], ["t", "id"], "l", include_current=False).collect():
        assert r.l == next((x[3] for x in reversed(before[r.id]) if x[3] is not None), None)
    for r in prefix.last_non_null(df, F.col("v"), ["k"], ["t", "id"], "l").collect():
        assert r.l == (r.v if r.v is not None else next((x[3] for x in reversed(before[r.id]) if x[3] is not None), None))


def test_no_key(spark):
    df = spark.range(1000).withColumn("v", F.lit(2))
    got = prefix.running_sum(df, "v", [], ["id"], "s")
    assert all(r.s == 2 * (r.id + 1) for r in got.collect())


def test_one_exchange_serves_both_sides(spark):
    data, schema = rows(2)
    df = spark.createDataFrame(data, schema)
    got = prefix.running_sum(df, "v", ["k"], ["t", "id"], "s")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1 and "rangepartitioning" in final


def test_building_runs_no_job(spark):
    data, schema = rows(3)
    df = spark.createDataFrame(data, schema)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    prefix.previous_value(prefix.running_sum(df, "v", ["k"], ["t", "id"], "s"), F.col("s"), ["k"], ["t", "id"], "p")
    jobs = tracker.getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert not jobs
