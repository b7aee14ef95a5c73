import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import documents, mixed_bag
from tidewater.llm import exact_dedup


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=200))
def test_rice_round_trip(gaps):
    assert exact_dedup.rice_decode(len(gaps), *exact_dedup.rice_encode(gaps)).tolist() == gaps


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    out, taken = [], set()
    for r, t in zip(rows, norm):
        ids = [x[0] for x, u in zip(rows, norm) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        kept = r[0] == keep and t not in taken
        if kept:
            taken.add(t)
        out.append((r[0], keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def groups(df):
    return sorted((tuple(r) for r in exact_dedup.exact_groups(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = mixed_bag() + [(40 + i, "same\n text", None, None) for i in range(300)] + [(30, "same  text", None, None)]
    assert groups(documents(spark, rows).repartition(5, "doc_id")) == brute(rows)


def test_one_task_and_empty(spark):
    rows = mixed_bag(3)
    assert groups(documents(spark, rows).coalesce(1)) == brute(rows)
    assert groups(documents(spark, [])) == []


def test_chance_hits_are_verified(spark, monkeypatch):
    """With very short fingerprints most rows are suspects; texts decide."""
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", -8)
    monkeypatch.setattr(exact_dedup, "LEAST_OWNERS", 2)
    rows = mixed_bag(1) + [(100 + i, f"text {i % 150}", None, None) for i in range(400)]
    assert groups(documents(spark, rows).repartition(4)) == brute(rows)


def test_drop_copies_keeps_columns(spark):
    rows = mixed_bag()
    df = documents(spark, rows)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    sha = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest() for r in out.collect()]
    assert sorted((str(r.doc_id), s) for r, s in zip(out.collect(), sha)) == sorted((str(r[0]), r[4]) for r in brute(rows) if r[3])
