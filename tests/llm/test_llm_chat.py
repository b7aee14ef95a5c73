import hashlib
import random

import duckdb
import pytest

from tidewater.llm import chat
from tidewater.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Rendered parts of the maximal conversations, by comparing lists."""
    convs = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        convs.setdefault(c, set()).add((t is None, t or 0, hashlib.sha256(f"{r}\n{x}".encode()).hexdigest(), r, x))
    lists = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    out = []
    for c in sorted(lists, key=lambda c: (c is None, c or 0)):
        mine = lists[c]
        same = [d for d, other in lists.items() if other == mine]
        first = min((d for d in same if d is not None), default=None)
        if first != c or any(len(o) > len(mine) and o[:len(mine)] == mine for o in lists.values()):
            continue
        for p in range(0, len(mine), chat.PART):
            text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in mine[p:p + chat.PART])
            out.append((c, p // chat.PART, len(mine), len(same), text))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, digest string, n int, part string, block int")


def got(df):
    return sorted((tuple(r) for r in chat.render(df).collect()), key=str)


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(df) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_oracle_agrees(spark):
    from tidewater.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.sql(ORACLE["op9_snapshot_collapse"])
    out = QUERIES["op9_snapshot_collapse"](spark, SF)
    assert out.columns == rel.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rel.fetchall(), key=str)


@pytest.mark.parametrize("block", [chat.BLOCK, 2])
def test_snapshots_ties_and_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "PART", 5)
    rng = random.Random(2)
    rows, c = [], 0
    for _ in range(12):
        talk = [("user" if i % 2 == 0 else "assistant", f"say {rng.randrange(4)} {{%s}}") for i in range(rng.randrange(1, 13))]
        for n in {len(talk), *(rng.randrange(1, len(talk) + 1) for _ in range(3))}:
            rows += [(c, i, r, x) for i, (r, x) in enumerate(talk[:n])]
            c += 1
    rows += rows[:7]  # repeated
    rows += [(900, 1, "user", "a"), (900, 1, "user", "b"), (901, 1, "user", "b"), (901, 1, "user", "a"),  # ties
             (902, None, None, None), (902, 0, "user", None), (903, 0, "user", ""),
             (None, 0, "user", "lost"), (None, 1, None, "found"), (904, -5, "user", "early"), (904, 700, "user", "late")]
    assert got(frame(spark, rows)) == brute(rows)


def test_a_hot_conversation_without_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    rows = [(None, None, "user", f"line {i}") for i in range(300)] + [(7, i % 3, "user", f"line {i}") for i in range(300)]
    df = frame(spark, rows)
    assert got(df) == brute(rows)
    placed, _ = chat.prefixes(df)
    assert max(r["count"] for r in placed.groupBy("conv_id", "block").count().collect()) == 16


def test_empty(spark):
    assert got(frame(spark, [])) == []
