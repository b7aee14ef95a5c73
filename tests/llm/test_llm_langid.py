import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from llm_cases import documents, mixed_bag
from tidewater.llm import langid

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(out) == len(rows)
    assert all(out[r.doc_id].held_out == held(r.doc_id) for r in rows)
    tested = [out[r.doc_id].lang_pred == r.lang for r in rows if held(r.doc_id)]
    assert np.mean(tested) >= 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = langid.fit(docs)
    a = langid.classify(docs, model, ["doc_id"]).collect()
    shown = docs.selectExpr("doc_id + 0 as doc_id", "text", "'xx' as lang", "'s' as source")
    assert a == langid.classify(shown, model, ["doc_id"]).collect()


def test_windows_cover_whole_texts():
    raw = bytes(range(1, 201)) * 3
    w = langid.windows_of(raw, 256)
    assert w.shape == (3, 256) and w.ravel()[:600].tobytes() == raw and not w.ravel()[600:].any()


def test_pair_tables_equal_plain_convolution():
    rng = np.random.default_rng(0)
    s = langid.Settings()
    model = langid.train([("a", b"aaa bbb " * 40), ("b", b"ccc ddd " * 40)], langid.Settings(epochs=1))
    net, x = langid.Predictor(model), rng.integers(0, 256, (5, s.window), dtype=np.uint8)
    feats = []
    for w in s.widths:
        n = s.window - w + 1
        r = sum(model[f"conv{w}"][j][x[:, j:j + n]] for j in range(w))
        feats.append(np.maximum(r.max(axis=1) + model[f"bias{w}"], 0))
    z = np.concatenate(feats, axis=1) @ model["out"] + model["out_bias"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4)


def test_odd_rows(spark):
    rows = mixed_bag() + [(90, "12 34 !!", "en", "s"), (91, None, "de", "s")]
    out = langid.predict_languages(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (20, 21, 22, 90, 91):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "de", "und") for r in out)
    assert langid.predict_languages(documents(spark, [])).collect() == []
    nothing = langid.predict_languages(documents(spark, [(1, "text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_stage_keeps_rows_with_a_language(spark):
    rows = mixed_bag()
    df = documents(spark, rows)
    out = langid.keep_known(df)
    assert out.columns == df.columns
    want = [r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, want))


def test_stage_without_labelled_rows_keeps_texts(spark):
    rows = [(r[0], r[1], None, r[3]) for r in mixed_bag()]
    want = [r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(str, (r.doc_id for r in langid.keep_known(documents(spark, rows)).collect()))) == sorted(map(str, want))


def test_stage_rejects_by_the_network(spark):
    rng = random.Random(5)
    kinds = {"aa": "nalo temi rusa kopi dela vomi".split(), "bb": "schrund pfech zwyk thrax bluft gnorr".split()}

    def text(words, n=60):
        return " ".join(rng.choice(words) for _ in range(n))

    clean = [(i, text(kinds["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb", "s") for i in range(1500)]
    strange = [(2000 + i, "的一是不了人我在有他 " * (20 + i), None, "s") for i in range(20)]
    strange += [(2100 + i, text(kinds["aa"]) + " " + text(kinds["bb"]), None, "s") for i in range(20)]
    assert sum(held(i) for i, *_ in clean) >= langid.Settings().least_rows
    kept = {r.doc_id for r in langid.keep_known(documents(spark, clean + strange)).collect()}
    assert {i for i, *_ in clean if held(i)} <= kept
    assert sum(i in kept for i, *_ in clean) >= 0.99 * len(clean)
    assert not kept & {i for i, *_ in strange}


def test_threshold_reads_every_held_out_document(spark):
    """The least certain document counts wherever a hash of its id lies."""
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    high = "pmod(xxhash64(doc_id, 10L), 1073741824)"
    ids = spark.range(24000).withColumnRenamed("id", "doc_id").where(langid.held_out(F.col("doc_id")))
    odd = ids.selectExpr(f"max_by(doc_id, {high}) AS m").first().m
    lang = model["languages"][0]
    docs = ids.selectExpr("doc_id", f"if(doc_id = {odd}, 'zq#x 91 k%v', 'one and the same text of a plain kind') AS text", f"'{lang}' AS lang")
    low = langid.classify(docs, model, ["doc_id"]).agg(F.min("_score")).first()[0]
    alone = langid.classify(docs.where(F.col("doc_id") == odd), model, ["doc_id"]).first()._score
    # Sums in another order differ a little.
    assert docs.count() > 5000 and abs(alone - low) < 1e-6
    assert abs(langid.lowest_score(docs, model) - (low - 1e-4)) < 1e-6
