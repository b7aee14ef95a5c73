from tidewater.llm import packing
from tidewater.llm.common import SMALL_BATCHES, holding, settle

KEYS = list(SMALL_BATCHES)


def test_texts_reach_the_workers_in_small_batches(spark, tmpdir_path, monkeypatch):
    settle(spark)
    before = [spark.conf.get(k, None) for k in KEYS]
    spark.range(300).selectExpr("id AS doc_id", "repeat('lorem ', 4000) AS text").coalesce(1).write.parquet(f"{tmpdir_path}/docs")
    held = []

    def probe(docs, *_):
        """One piece for each batch, with the batch's bytes as its start."""
        held.append([spark.conf.get(k, None) for k in KEYS])

        def run(parts):
            import pyarrow as pa

            for part in parts:
                row = [[0], [0], [part.nbytes], [1], [part.num_rows]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, [pa.int64(), pa.int32(), *[pa.int64()] * 3])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.select("doc_id", "text").mapInArrow(run, packing.PIECES)

    monkeypatch.setattr(packing, "cut_pieces", probe)
    out = packing.pack_documents(spark.read.parquet(f"{tmpdir_path}/docs")).collect()
    assert sum(r.ids_crc32 for r in out) == 300
    assert sum(r.start for r in out) > 300 * 24_000
    assert max(r.start for r in out) < 2 << 20
    assert held == [list(SMALL_BATCHES.values())]
    assert [spark.conf.get(k, None) for k in KEYS] == before


def test_settings_return_after_a_failure(spark):
    settle(spark)
    before = [spark.conf.get(k, None) for k in KEYS]
    try:
        with holding(spark, SMALL_BATCHES):
            raise KeyError
    except KeyError:
        pass
    assert [spark.conf.get(k, None) for k in KEYS] == before
