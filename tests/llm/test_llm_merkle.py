import hashlib
import random
import zlib

import numpy as np
import pytest

from llm_cases import documents, mixed_bag
from tidewater.llm import merkle


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lowered=False):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    text = r["text"]
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha([field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(r["n_chars"]), field(text)])


def levels(row):
    found = [row]
    while len(found[-1]) > 1:
        found.append([sha(found[-1][i:i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def path(rows, i):
    out = []
    for row in rows[:-1]:
        out.append((row[i // 8 * 8:i], row[i + 1:i // 8 * 8 + 8]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        groups[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[x] = levels([leaf(r) for r in groups[x]])
    top = levels([trees[x][-1][0] for x in langs])
    root = top[-1][0]
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            steps = path(trees[x], i) + path(top, k)
            altered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf(r, altered)
            for a, b in steps:
                node = sha(a + [node] + b)
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], root, sha([h for a, b in steps for h in a + b]), node, node == root))
    return sorted(out, key=repr)


def assert_like(df):
    rows = [r.asDict() for r in df.collect()]
    got = merkle.verified_documents(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7])
def test_addresses_fill_the_block(n):
    places = np.concatenate([merkle.address(d, np.arange(merkle.FAN ** d), n) for d in range(n)]) if n < 7 else None
    if places is not None:
        assert sorted(places.tolist()) == list(range(merkle.nodes_in(n)))
    assert merkle.address(0, np.arange(1), n)[0] == 0


def test_a_lower_subtree_lies_together():
    # Five levels split into two above and three below, 73 nodes each.
    first = 9 + 73 * 5
    below = [merkle.address(2, np.array([5]), 5), merkle.address(3, np.arange(40, 48), 5), merkle.address(4, np.arange(320, 384), 5)]
    assert sorted(np.concatenate(below).tolist()) == list(range(first, first + 73))


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 500, 4096])
def test_block_and_siblings(size):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(size)]
    want = levels([d.hex() for d in digests])
    rows = merkle.block_rows(merkle.build_block(digests, size), size, 0)
    assert [r.decode() for r in rows] == ["".join(w) for w in want]
    for i in {0, size // 2, size - 1}:
        assert [(a.decode(), b.decode()) for a, b in merkle.siblings(rows, i)] \
            == [("".join(a), "".join(b)) for a, b in path(want, i)]


def test_mixed_rows(spark):
    assert_like(documents(spark, mixed_bag()))


@pytest.mark.parametrize("deep", [1, 2])
def test_tiers_of_blocks(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "LEVELS", deep)
    rng = random.Random(deep)
    rows = [(i, f"Text {i}", rng.choice(["en", "en", "de", None]), "s") for i in range(700)]
    rows += [(1000 + i, "Some Text", f"lang{i}", None) for i in range(80)]
    rows += [(5, "Same Copy", "en", "s")] * 30
    assert_like(documents(spark, rows))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_one_group_of_few(spark, n):
    assert_like(documents(spark, [(i, f"T{i}", "en", "s") for i in range(n)]))


def test_given_documents(spark):
    import __spark_entry__ as entry

    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = entry.queries()["op13_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table_has_no_root(spark):
    empty = documents(spark, [(1, "a")]).limit(0)
    assert merkle.Manifest(merkle.leaves_of(empty)).root is None
    assert merkle.verified_documents(empty).collect() == []


def test_tables_are_stored_once_a_node(spark):
    docs = documents(spark, [(i, f"T{i}", "en", "s") for i in range(100)])
    made = merkle.Manifest(merkle.leaves_of(docs))
    row = made.tiers[0].first()
    assert len(row["layout"]) == 32 * merkle.nodes_in(4) and made.root == levels([made.tiers[0].first()["root"].hex()])[0][0]
