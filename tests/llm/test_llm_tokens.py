import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import documents, mixed_bag
from tidewater.llm import token_files, token_output, tokens


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def rows_with_marks():
    return mixed_bag() + [(70, "ends <|endoftext|> here", None, None)]


def test_counts_equal_tokenising_each_text(spark, ids_of):
    rows = rows_with_marks()
    path = tempfile.mkdtemp(prefix="tw-docs-") + "/docs"
    documents(spark, rows).repartition(3).write.parquet(path)
    out = token_files.count_tokens(spark.read.parquet(path)).collect()
    got = sorted((str(r.doc_id), r.n_tokens) for r in out)
    assert got == sorted((str(r[0]), len(ids_of(r[1]))) for r in rows)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_blocks_are_stitched(spark, block):
    """Documents over many blocks, empty ones, and a file without a last end."""
    end = 9
    files = {0: [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 1, 9], 1: [9], 2: [1] * 20, 3: [1, 9, 2], 4: [9, 9, 9]}
    path = tempfile.mkdtemp(prefix="tw-tok-")
    for k, ids in files.items():
        np.array(ids, "<u2").tofile(f"{path}/part-{k:05d}-x.txt")
    want = []
    for k, ids in files.items():
        start, nth = 0, 0
        for i, t in enumerate([*ids, None]):
            if t == end or (t is None and start < len(ids)):
                want.append((k, nth, start, i - start))
                start, nth = i + 1, nth + 1
    got = token_files.scan_token_files(spark, path, block, end).collect()
    assert sorted((r.shard, r.nth, r.start, r.n_tokens) for r in got) == sorted(want)


def test_no_documents(spark):
    path = tempfile.mkdtemp(prefix="tw-docs-") + "/docs"
    documents(spark, []).write.parquet(path)
    df = spark.read.parquet(path)
    assert token_files.count_tokens(df).collect() == []
    assert token_output.shard_digest(df).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 62))
def test_feistel_is_a_permutation(n, key):
    f = token_output.Feistel(n, key)
    slots = f(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f(slots, back=True).tolist() == list(range(n))


def test_shards_hold_all_ids_in_slot_order(spark, ids_of):
    rows = rows_with_marks()
    path = tempfile.mkdtemp(prefix="tw-shards-") + "/out"
    df = documents(spark, rows).coalesce(1)
    placed = token_output.materialise(df, path, length=32, per_shard=10)
    n = placed.count()
    back = {r.slot: r for r in token_output.read_slots(spark, path, 32, 10).collect()}
    assert sorted(back) == list(range(n))
    assert all(r.byte_offset == r.slot % 10 * 66 and r.shard == r.slot // 10 for r in back.values())
    order = token_output.Feistel(n)(np.arange(n))
    flat = np.frombuffer(b"".join(back[s].ids for s in order), "<u2").tolist()
    want = [t for r in df.collect() for t in [*ids_of(r.text), token_files.END_ID]]
    assert flat[:len(want)] == want and set(flat[len(want):]) <= {token_files.END_ID} and len(flat) - len(want) < 32
    some = token_output.read_slots(spark, path, 32, 10, first=7, stop=23).collect()
    assert sorted(r.slot for r in some) == list(range(7, 23))
    assert all(bytes(r.ids) == bytes(back[r.slot].ids) for r in some)


def test_slot_order_survives_spills(spark, ids_of):
    rows = rows_with_marks()
    path = tempfile.mkdtemp(prefix="tw-shards-") + "/out"
    df = documents(spark, rows).coalesce(1)
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    name = "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "20")
    try:
        n = token_output.materialise(df, path, length=32, per_shard=300).count()
    finally:
        conf.remove(name)
    back = {r.slot: r.ids for r in token_output.read_slots(spark, path, 32, 300).collect()}
    flat = np.frombuffer(b"".join(back[s] for s in token_output.Feistel(n)(np.arange(n))), "<u2").tolist()
    want = [t for r in df.collect() for t in [*ids_of(r.text), token_files.END_ID]]
    assert n > 900 and flat[:len(want)] == want


def test_digest(spark, ids_of):
    rows = rows_with_marks()
    out = token_output.shard_digest(documents(spark, rows).repartition(3), length=64, per_shard=7).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    ends = sum(r.n_ends for r in out)
    total = sum(len(ids_of(r[1])) + 1 for r in rows)
    assert len(out) * 64 >= total and ends == len(rows) + len(out) * 64 - total
    assert {r.doc_id for r in out} <= {r[0] for r in rows}
    assert all(0 <= r.ids_crc32 <= 0xFFFFFFFF for r in out)
    assert zlib.crc32(b"") == 0
