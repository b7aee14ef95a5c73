import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewater.llm import chat_repair as cr

WS = " \t\n\x0b\x0c\r"
THEN = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEP = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAME = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string, kind string, no string, digest string, position string"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, r, x in rows:
        bare = x.strip(WS)
        found.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    return found


def cheapest(turns):
    """Plain dynamic programming: (cost, edits) of (fault, initial) turns."""
    def closed(now):
        for _ in range(3):
            for q, (c, a) in list(now.items()):
                now[THEN[q]] = min(now.get(THEN[q], (1 << 30, "")), (c + 5, a + "I"))
        return now

    now = {"": (0, "")}
    for fault, initial in turns:
        then = {}
        for q, (c, a) in closed(now).items():
            steps = [(q, c + 2, a + "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                steps.append((THEN[q], c + 1 + more, a + "R"))
                if (q, initial) in KEEP:
                    steps.append((initial, c + more, a + "K"))
            for to, *label in steps:
                then[to] = min(then.get(to, (1 << 30, "")), tuple(label))
        now = then
    return min(v for q, v in closed(now).items() if q in ("", "a"))


def brute(conv, rows):
    def digest(r, x):
        return hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()

    rows = sorted(rows, key=lambda z: (z[1] is not None, z[1] or 0, z[2].encode(), digest(z[2], z[3])))
    found = faults(rows)
    turns = [z[1] for z in rows if z[1] is not None]
    initials = [z[2][:1] for z in rows]
    cost, audit = cheapest(list(zip(found, initials)))
    last, lines, left = "", [], iter(rows)
    for e in audit:
        r, x = (None, "") if e == "I" else next(left)[2:]
        if e == "K":
            last = r[:1]
        elif e in "RI":
            last = THEN[last]
            r = NAME[last]
        if e != "D":
            lines.append(f"{r}:{x}")
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[found.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_all(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    return sorted((brute(c, rs) for c, rs in groups.items()), key=repr)


def assert_like(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, cr.repaired_conversations(df).collect()), key=repr) == brute_all(rows)


CLASS = {"": cr.SOUND, "truncated": cr.CUT_OFF, "blank": cr.VOID}


def test_all_short_lattices():
    kinds = list(itertools.product(CLASS, ["u", "a", "s", "t"]))[:9]
    for n in range(5):
        for turns in itertools.product(kinds, repeat=n):
            got = cr.Lattice([(CLASS[f], i) for f, i in turns]).best(cr.START, cr.CLOSING)
            assert got == cheapest(turns), turns


def test_long_random_lattices():
    rng = random.Random(4)
    for n in (10, 40, 200):
        for _ in range(20):
            turns = [(rng.choice(["", "", "truncated", "blank"]), rng.choice("uuaaast ")) for _ in range(n)]
            got = cr.Lattice([(CLASS[f], i.strip()) for f, i in turns]).best(cr.START, cr.CLOSING)
            assert got == cheapest([(f, i.strip()) for f, i in turns])


@pytest.mark.parametrize("size", [1, 2, 5])
def test_segments_join_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(200):
        turns = [(rng.choice(["", "", "truncated", "blank"]), rng.choice("uuaaast")) for _ in range(rng.randrange(1, 14))]
        best = cr.Best()
        for i in range(0, len(turns), size):
            part = turns[i:i + size]
            best.add({"first": part[0][1], "last": part[-1][1], "illegal": 0,
                      "paths": cr.Lattice([(CLASS[f], x) for f, x in part]).paths(False)})
        assert best.result() == cheapest(turns)


def random_rows(seed, n, convs):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(25)]),
             rng.choice([None, "system", "user", "assistant", "tool", "", "user", "assistant"]),
             rng.choice([None, "", "ok.", "x", "y", "Fine!", "a b. ", " \t", "q?\n", "long. " * 3000, "é中"])) for _ in range(n)]


def test_mixed_rows(spark):
    assert_like(spark, random_rows(1, 300, 12))


@pytest.mark.parametrize("size", [3, 256])
def test_a_hot_conversation(spark, monkeypatch, size):
    monkeypatch.setattr(cr, "SEGMENT", size)
    rng = random.Random(size)
    hot = [(77, i, rng.choice(["user", "assistant", "system"]), f"w{rng.randrange(900)}" + rng.choice([".", "", "!"]))
           for i in range(1500)]
    same = [(88, 5, "user", "same.")] * 300 + [(89, None, "user", "same.")] * 40
    assert_like(spark, hot + same + random_rows(2, 60, 6))


def test_conversations_that_lose_all_rows_stay(spark):
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    rows = gone + [(500, 1, "user", "a."), (500, 2, "assistant", "b.")]
    assert_like(spark, rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "user", "Hi."), (1, 4, "tool", "Yes."), (2, 1, None, None)]
    got = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got if r.position] \
        == [(1, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (1, "R", "assistant", "Yes.")]
    assert [(r.conv_id, r.gaps, r.duplicate, r.cost, r.audit) for r in got if not r.position] == [(1, 1, 1, 3, "KKDR"), (2, 0, 0, 2, "D")]


def test_given_conversations(spark):
    import __spark_entry__ as entry

    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = entry.queries()["op11_structure_repair"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == brute_all([tuple(r) for r in given])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repaired_conversations(df).collect() == []
