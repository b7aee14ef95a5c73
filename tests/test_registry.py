"""Extension surface, periodic jobs, raw ingest stream, manifests."""

import os

import pytest
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.sinks import spool as S
from tidewater.sources import fixtures as fx
from tidewater.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_input_registry(spark):
    assert {"kafka", "nats", "sqs", "kinesis", "http"} <= set(registry.list_inputs())
    with pytest.raises(ValueError):
        registry.register_input("kafka", lambda **kw: (lambda df: df))
    with pytest.raises(KeyError):
        registry.create_input("nope")
    t = registry.create_input("kinesis", tenant_id="t", dataset_id="d")
    out = t(fx.kinesis_records(spark, SF))
    assert set(out.columns) >= {"tenant_id", "dataset_id", "data", "metadata"}


def test_input_catalog(spark):
    c = registry.input_catalog(spark)
    assert c.count() == len(registry.INPUT_CATALOG)
    fields = c.select("name", F.explode("fields").alias("f")).where("name = 'syslog'")
    assert sorted(r.f.name for r in fields.collect()) == ["host", "port", "read_buffer_size"]
    assert all(r.f.description for r in c.select(F.explode("fields").alias("f")).collect())
    cfg = spark.createDataFrame([(1, "kafka", "k", {"brokers": "b", "topics": "t", "auto_offset_reset": "first"}),
                                 (2, "udp", "u", {"port": "1"}), (3, "own", "o", {"x": "y"})],
                                "pos long, type string, name string, config map<string,string>")
    got = sorted((r.pos, r.error) for r in registry.config_field_errors(cfg).collect())
    assert got == [(1, "auto_offset_reset: no such option"), (1, "group_id: needed")]


def test_formatters(spark):
    df = spark.createDataFrame([(" {\"a\": 1} ",)], "v string")
    assert df.select(registry.formatter("ndjson")(F.col("v"))).first()[0] == '{"a":1}'
    assert df.select(registry.formatter("")(F.col("v"))).first()[0] == ' {"a": 1} '
    assert df.select(registry.formatter("apache")(F.col("v"))).first()[0] == '{"a": 1}'
    with pytest.raises(ValueError):
        registry.register_formatter("raw", lambda c: c)


def test_manifest_placeholders(spark):
    f = fx.spool_files(spark, SF).limit(3)
    m = S.delivery_manifest(f, "https://r.example/{tenantid}/in/{datasetid}", global_token="g").collect()
    assert all(r.url == f"https://r.example/{r.tenant_id}/in/{r.dataset_id}" for r in m)
    f2 = f.withColumn("bearer_token", F.lit(""))
    assert all(r.headers["Authorization"] == "Bearer g" for r in S.delivery_manifest(f2, "https://r", global_token="g").collect())


def test_periodic_job_and_ingest_stream(spark, tmpdir_path):
    jobs.prepare_streaming(spark)
    msgs = fx.messages(spark, SF)
    src = os.path.join(tmpdir_path, "msgs")
    msgs.coalesce(1).write.parquet(src)
    sink = os.path.join(tmpdir_path, "raw")
    q = jobs.ingest_stream(spark, src, msgs.schema, sink, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(300)
    landed = spark.read.parquet(sink)
    from tidewater.plans import ingest
    assert landed.count() == ingest.land_lines(msgs).count()
    assert set(landed.columns) >= {"tenant_id", "dataset_id", "stamped", "wrapped"}

    # foreachBatch landing with the detection memo as a table: two runs over
    # one checkpoint give the batch result.
    half = msgs.approxQuantile("seq", [0.5], 0.0)[0]
    src2 = os.path.join(tmpdir_path, "msgs2")
    msgs.where(F.col("seq") < half).coalesce(1).write.parquet(src2)
    sink2, ck2 = os.path.join(tmpdir_path, "raw2"), os.path.join(tmpdir_path, "ckpt2")
    jobs.ingest_stream_batches(spark, src2, msgs.schema, sink2, ck2).awaitTermination(300)
    msgs.where(F.col("seq") >= half).coalesce(1).write.mode("append").parquet(src2)
    jobs.ingest_stream_batches(spark, src2, msgs.schema, sink2, ck2).awaitTermination(300)
    got = {(r.seq, r.line_no): r.wrapped for r in spark.read.parquet(sink2).collect()}
    exp = {(r.seq, r.line_no): r.wrapped for r in ingest.land_lines(msgs).collect()}
    assert got == exp

    seen = []

    def job(batch_df, batch_id):
        seen.append((batch_id, batch_df.count()))

    stream = spark.readStream.schema(msgs.schema).parquet(src)
    p = jobs.run_periodic(spark, stream, job, os.path.join(tmpdir_path, "pckpt"), every=None)
    p.awaitTermination(300)
    assert sum(n for _, n in seen) == msgs.count()
