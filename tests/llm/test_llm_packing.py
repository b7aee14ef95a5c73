import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import documents, mixed_bag
from tidewater.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


ODD = ["", "Plain text.", "MiXeD Case's don't", "a b c　d", "x\x1cy\x1dz", "ΟΔΟΣ ΣΑΣ", "İstanbul İ",
       "éå", "a\x02b \x02 c", "<|endoftext|> A<|endoftext|>B <|ENDOFTEXT|> <|start", "word" * 50, "w" * 3000,
       "123 4.5.6 ###$$$", "日本語 テキスト", "tab\tnew\nline\r\n\x0b\x0c end ", "\x85next", "emoji 👍🏽 ok"]


def test_units_give_the_ids_of_whole_texts(tokenizer):
    enc = tokens.UnitEncoder(None)
    for _ in range(2):  # cold, then from the memo
        got = enc.encode_many([t.encode() for t in ODD] + [None])
        for t, raw in zip(ODD, got):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
        assert got[-1] == b""


def test_given_documents(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = tokens.UnitEncoder(None).encode_many([t.encode() for t in texts])
    assert all(np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
               for t, raw in zip(texts, got))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 10)
    monkeypatch.setattr(tokens, "MEMO_PARTS", 10)
    enc = tokens.UnitEncoder(None)
    one = enc.encode_many([b" ".join(b"w%d" % i for i in range(50))])
    assert enc.encode_many([b" ".join(b"w%d" % i for i in range(50))]) == one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.sampled_from([24, 60]))
def test_plan_fills_bins_gapless(lengths, capacity):
    lengths = [min(x, capacity) for x in lengths]
    hist = {x: lengths.count(x) for x in set(lengths)}
    bins = {}
    runs = sorted(packing.plan_runs(hist, capacity))
    for i, (length, first, at, per, offset) in enumerate(runs):
        stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else hist[length]
        for k in range(stop - first):
            bins.setdefault(at + k // per, []).append((offset + k % per * length, length))
    assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * x > capacity for _, x in b) <= 2
    # Never worse than first-fit decreasing by more than a bin.
    ffd = []
    for x in sorted(lengths, reverse=True):
        spot = next((i for i, room in enumerate(ffd) if room >= x), None)
        if spot is None:
            ffd.append(capacity - x)
        else:
            ffd[spot] -= x
    assert len(bins) <= len(ffd) + 1


def check_pieces(rows, out, tokenizer, capacity):
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), capacity):
            part = ids[p:p + capacity]
            want.append((r[0] is None, r[0] or 0, p // capacity, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert sorted(got) == sorted(want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return seqs


@pytest.mark.parametrize("salts", [packing.ROWS_PER_SALT, 5])
def test_pack_documents(spark, tokenizer, monkeypatch, salts):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", salts)
    rows = mixed_bag()
    out = packing.pack_documents(documents(spark, rows)).collect()
    seqs = check_pieces(rows, out, tokenizer, 2048)
    assert len(seqs) <= -(-sum(r.length for r in out) // 2048) + 1


def test_ids_round_trip(spark, tokenizer):
    out = packing.cut_pieces(documents(spark, mixed_bag()[:5]), capacity=16, with_ids=True).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for i, t, *_ in mixed_bag()[:5]:
        assert by[i] == tokenizer.encode(t, add_special_tokens=False).ids + [0]


def test_empty(spark):
    assert packing.pack_documents(documents(spark, [])).collect() == []
