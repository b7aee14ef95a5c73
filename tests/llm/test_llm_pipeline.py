import re
from collections import Counter

import pytest

import corpus_pipeline
from llm_cases import documents, mixed_bag
from test_llm_near_dedup import brute
from tidewater.llm import packing
from tidewater.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = cut(stage(spark, docs, SF))
        after = docs.collect()
        assert docs.columns == names and set(map(tuple, after)) <= set(map(tuple, before.values()))
        ids = [r.doc_id for r in after]
        if name == "language ID":
            assert set(ids) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "exact dedup":
            texts = {}
            for i, r in sorted(before.items(), reverse=True):
                texts[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)] = i
            assert sorted(ids) == sorted(texts.values())
        elif name == "MinHash near-dedup":
            groups = brute([(i, r.text) for i, r in before.items()], 5)
            assert sorted(ids) == sorted(i for i, (_, c) in groups.items() if i == c)
        else:
            assert max(Counter(ids).values()) <= 3 and len(ids) > 0
        kept[name] = len(ids)
    assert kept["exact dedup"] < kept["language ID"] and kept["MinHash near-dedup"] < kept["exact dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    pieces = packing.cut_pieces(docs).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) \
        == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


@pytest.mark.parametrize("rows", [[], mixed_bag()])
def test_odd_tables(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == bool(rows)
    if rows:
        assert {r.doc_id for r in out} <= {r[0] for r in rows} - {20, 21, 22}


def test_reruns_agree(spark):
    a = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    b = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert Counter(a) == Counter(b)
