import random
import re

import numpy as np
import pytest

from llm_cases import documents, mixed_bag, prose
from tidewater.llm import near_dedup

SF = "/root/testdata/sf0.001"


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    if len(w) < words:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1))


def brute(rows, words, percent=80):
    """doc_id -> (set size, component), by comparing all pairs."""
    sets = {}
    for r in rows:
        sets.setdefault(r[0], shingles(r[1], words))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, words, **more):
    out = near_dedup.near_groups(df, words=words, **more).collect()
    for r in out:
        assert r.kept == (r.doc_id == r.component_id)
    return out


def agree(df, rows, words, **more):
    out = found(df, words, **more)
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute(rows, words)


def test_hasher_tells_words_apart():
    hasher = near_dedup.WordHasher()
    texts = [f"w{i} x{i % 7} {i * 31}".encode() for i in range(5000)]
    starts, h = hasher.hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    words = b"\n".join(texts).split()
    assert len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words))
    assert all(len({x for x, w in zip(h.tolist(), words) if w == u}) == 1 for u in set(words[:40]))


def test_pieces_do_not_change_sets(monkeypatch):
    texts = [t.encode() if t else None for _, t, *_ in mixed_bag()]
    hasher = near_dedup.WordHasher()
    whole = near_dedup.shingle_sets(texts, 4, hasher)
    monkeypatch.setattr(near_dedup, "PIECE_BYTES", 100)
    parts = near_dedup.shingle_sets(texts, 4, hasher)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts))
    assert [len(s) for s in whole] == [len(shingles(t, 4)) for _, t, *_ in mixed_bag()]


def test_least_shared_is_a_tail_bound():
    rng = np.random.default_rng(0)
    for k in (8, 48):
        assert (rng.binomial(k, 0.8, 200_000) < near_dedup.least_shared(k, 80)).mean() < 1e-4


@pytest.mark.parametrize("words", [4, 5])
def test_given_documents_against_all_pairs(spark, words):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    agree(df, [(r.doc_id, r.text) for r in df.collect()], words)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 8])
def test_graded_copies_chains_and_passages(spark, monkeypatch, block):
    """Copies near the threshold, chains of them, and a passage that half of
    the documents share."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(1)
    rows, passage = [], prose(rng, 60)
    for g in range(8):
        base = prose(rng, 120).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(copy)))
    drift = prose(rng, 100).split()
    for i in range(25):
        drift[(7 * i) % 100] = f"drift{i}"
        rows.append((len(rows), " ".join(drift)))
    for _ in range(60):
        rows.append((len(rows), passage + " " + prose(rng, rng.choice([5, 20, 60, 90]))))
    rng.shuffle(rows)
    agree(documents(spark, rows), rows, 4)


def test_set_sizes_around_the_sketch(spark):
    """Isolated pairs of which one or both fit the sketch, at and around the
    threshold: passages of a text, and texts that differ on both sides."""
    rng = random.Random(3)
    rows = []

    def words(n):
        return ["w%d" % rng.randrange(10**12) for _ in range(n)]

    for small in range(40, 56):
        for large in range(small, 63):
            if not 79 * large <= 100 * small <= 85 * large:
                continue
            for _ in range(4):
                base = words(large + 3)
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:small + 3]))]
            # One value of the smaller set is new.
            base = words(large + 3)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:small + 2] + words(1)))]
    rng.shuffle(rows)
    agree(documents(spark, [(i, t, None, None) for i, t in rows]), rows, 4)


def test_bound_of_whole_sets_holds():
    """Over all values' orders at the threshold, by the worst one."""
    for sketch, percent in ((48, 80), (16, 50), (48, 90)):
        least = near_dedup.least_shared(sketch, percent)
        for n in range(1, sketch + 1):
            need = near_dedup.least_of_whole(n, sketch, percent)
            for m in range(n, n * 100 // percent + 1):
                for same in range(1, n + 1):
                    if 100 * same >= percent * (n + m - same):
                        assert need <= max(least if m > sketch else 0, same - max(0, m - sketch))


def test_odd_rows(spark):
    rows = mixed_bag()
    agree(documents(spark, rows), rows, 4)
    alone = [r for r in found(documents(spark, rows), 4) if r.doc_id is None]
    assert len(alone) == 2 and not any(r.component_id for r in alone)
    assert found(documents(spark, []), 4) == []


def test_drop_near_copies_keeps_one_of_each(spark):
    rows = [r for r in mixed_bag(2)]
    df = documents(spark, rows)
    out = near_dedup.drop_near_copies(df)
    assert out.columns == df.columns
    want = {i for i, (_, c) in brute(rows, 5).items() if i == c}
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 2


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {n: c for n, c in root.items() if n != c}
