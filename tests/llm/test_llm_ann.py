import math

import numpy as np
import pytest

from tidewater.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, k=20):
    """query -> [(vec_id, score)] by scoring everything."""
    uniq = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in uniq]), np.array([v for _, v in uniq], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def results(df, **more):
    got = {}
    for r in ann.search(df, "id % 20 = 0", **more).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [v[i] for i in sorted(v)] for q, v in got.items()}


def recall(got, want):
    hits = [len({v for v, _ in got[q]} & {v for v, _ in w}) / max(1, len(w)) for q, w in want.items()]
    return float(np.mean(hits))


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = results(df), brute(rows)
    assert got.keys() == want.keys()
    vec = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and q not in [v for v, _ in found]
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        for v, s in found[:3]:
            assert s == pytest.approx(float(np.dot(np.array(vec[q], float), np.array(vec[v], float))), abs=1e-12)
    assert recall(got, want) >= 0.9


def test_clusters_are_found_without_scanning_all(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.05 * rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    s = ann.Settings(least_leaf=32, calibrate=64, block=200)
    assert recall(results(df, settings=s), brute(rows)) >= 0.9


def test_copies_and_hot_vectors(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, gid long, vec string, id long")
    got, want = results(df), brute(rows)
    assert recall(got, want) >= 0.9
    assert got[0] == [(v, pytest.approx(s)) for v, s in want[0]]


def test_unusable_rows(spark):
    ok = [1.0, 2.0]
    rows = [(0, ok), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [math.nan, 1.0]),
            (6, [math.inf, 1.0]), (7, [1.0]), (None, ok), (20, [0.0, 0.0]), (40, ok), (60, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = results(df)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {0: [40, 1, 60], 40: [0, 1, 60], 60: [0, 40, 1]}
    assert results(df.where("vec_id < 0")) == {}
    assert results(df.where("vec_id = 0")) == {}
    assert results(df.where("vec_id in (1, 7)")) == {}


def test_blocks_of_rows_and_queries_meet(spark):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(5).normal(size=(900, 6)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = ann.Settings(block=100, ask_block=7, recall=2.0)  # takes everything
    got, want = results(df, settings=small), brute(rows)
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
