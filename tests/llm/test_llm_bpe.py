import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import documents, mixed_bag
from tidewater.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(None)


def ids_of(codec, texts):
    ids, counts = codec.encode_many(texts)
    ends = np.cumsum(counts)
    return [ids[e - n:e].tolist() for e, n in zip(ends, counts)]


def assert_like(codec, tokenizer, texts):
    got = ids_of(codec, texts)
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    raw, sizes = codec.decode_many(np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64))
    ends = np.cumsum(sizes)
    assert [raw[e - n:e].tobytes().decode() for e, n in zip(ends, sizes)] == [t or "" for t in texts]


ODD = ["", None, "Plain text.", "it's we'LL don't 'S 've", "  two  spaces \n\n\t x  ", " \x85 　  ", "՘՘ a՘",
       "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|ENDOFTEXT|> <|start", "日本語 テキスト", "emoji 👍🏽 ok",
       "123 4.5.6 ###$$$", "\x00\x1c\x1d nul", "é" * 3001]


def test_odd_texts_alone_and_together(codec, tokenizer):
    for t in ODD:
        assert_like(codec, tokenizer, [t])
    assert_like(codec, tokenizer, ODD * 2)


def test_long_unbroken_words(codec, tokenizer):
    rng = random.Random(5)
    assert_like(codec, tokenizer, [
        "A" * 50_001, "ab" * 20_000, "thequickbrownfox" * 2000, "日本語テキスト" * 2000, " " * 5000, "=-" * 9000 + "=",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)),
        "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(30_000))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    from tokenizers import Tokenizer

    assert_like(bpe.worker_codec(None), Tokenizer.from_file(bpe.default_path()), texts)


def test_every_character(codec, tokenizer):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(1).shuffle(chars)
    # Also characters that the two splitters class differently.
    assert_like(codec, tokenizer, ["a" + "1 ".join(chars[i:i + 2000]) for i in range(0, 200_000, 2000)])
    assert codec.unlike


def test_memo_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    own = bpe.Codec(None)
    for _ in range(3):
        assert_like(own, tokenizer, [" ".join(f"w{i}" for i in range(50))])
        assert not own.memo and not len(own.ids)


def test_ids_that_are_no_text(codec, tokenizer):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(20)]
        raw, _ = codec.decode_many(np.array(ids), np.array([len(ids)]))
        assert raw.tobytes().decode("utf-8", "replace") == tokenizer.decode(ids, skip_special_tokens=False)
    raw, sizes = codec.decode_many(np.array([-1, 60_000, 64]), np.array([1, 1, 1]))
    assert sizes.tolist() == [0, 0, 1]


def expected(tokenizer, key, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = [hashlib.sha256(x.encode()).hexdigest()
           for x in (",".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))]
    return key, len(ids), *sha


def test_query_on_mixed_rows(spark, tokenizer):
    rows = mixed_bag()
    got = [tuple(r) for r in bpe.digest(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((expected(tokenizer, r[0], r[1]) for r in rows), key=repr)


def test_query_on_given_documents(spark, tokenizer):
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = entry.queries()["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(expected(tokenizer, k, t) for k, t in docs.items())


def test_empty_table_and_odd_ids(spark):
    assert bpe.digest(documents(spark, [(1, "a")]).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 64]), (4, [136, 64]), (5, [99_999])],
                                 "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows).orderBy("doc_id").collect()] == ["", "", "a", "�a", ""]


def test_files_with_other_rules_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(bpe.default_path()))
    # A pair that ranks below the merge that makes its left half.
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Codec(str(path))
