import re
from collections import Counter, defaultdict

import pytest

from llm_cases import documents, mixed_bag
from tidewater.llm import mixing

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(rows):
    """Targets by raising one water level in small exact steps."""
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += size(r[1])
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None] * (None in sums)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, left, goal = set(order), float(sum(sums.values())), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if total and left * weight[s] / total > 3 * sums[s]}
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * sums[s]
            left -= goal[s]
        open_ -= over
    return sums, {**goal, **{s: left * weight[s] / total for s in open_}}


def check(df, rows):
    out = mixing.mix(df).collect()
    sums, goal = goals(rows)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sums[r.source]
        assert r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1e-6
    return out


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    a = check(df, rows)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, again))


@pytest.mark.parametrize("fan", [2, mixing.FAN_IN])
def test_odd_rows_and_deep_trees(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rows = mixed_bag() + [(200 + i, "w " * (1 + i % 9), None, "hot") for i in range(150)]
    rows += [(500, "a b c", None, "dup")] * 40 + [(501, None, None, "none")]
    check(documents(spark, rows), rows)


def test_expected_copies_are_kept(spark, monkeypatch):
    """Over many seeds each document's copies average to what it asks for."""
    items = spark.createDataFrame([("s", float(1 + i % 5), 0.3, i) for i in range(40)], "source string, s double, f double, id long")
    ones = Counter()
    for seed in range(8):
        monkeypatch.setattr(mixing, "SEED", seed)
        got = mixing.round_fractions(items, ["id"]).collect()
        assert len(got) == 40 and {r.bit for r in got} <= {0, 1}
        assert abs(sum(r.bit * (1 + r.id % 5) for r in got) - 0.3 * 120) <= 5
        ones.update(r.id for r in got if r.bit)
    assert 0.2 < sum(ones.values()) / 320 < 0.4
    assert max(ones.values()) <= 7


def decided(df):
    """Copies of all rows of a doc_id, source and size."""
    out = Counter()
    for r in mixing.mix(df).collect():
        out[r.doc_id, r.source, r.size] += r.copies
    return +out


def assert_rows_follow(df):
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got) == decided(df)
    return Counter((r.doc_id, r.source, r.text) for r in got)


def test_empty_and_rows(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.mixed_rows(documents(spark, [])).collect() == []
    assert_rows_follow(documents(spark, mixed_bag()))


def test_rows_without_an_id_are_documents_of_their_own(spark):
    rows = [(None, f"text {i} " + "w " * (i % 7), "en", f"s{i % 3}") for i in range(120)]
    rows += [(None, None, None, "s0"), (None, "", None, "s1"), (None, "same text", "en", "s0"), (1, "same text", "en", "s0")]
    rows += [(None, "alike in all", "en", "s2")] * 9 + [(7, "alike in all", "en", "s2")] * 5
    got = assert_rows_follow(documents(spark, rows))
    # Rows that ask for the same number of copies differ by one at most.
    for s, n in {(s, size(x)) for _, x, _, s in rows}:
        copies = [got[None, s, x] for x in {x for i, x, _, t in rows if i is None and t == s and size(x) == n and x != "alike in all"}]
        assert not copies or max(copies) - min(copies) <= 1
