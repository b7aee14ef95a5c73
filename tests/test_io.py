"""File sources and sinks: spool scan, metadata, batch writes, layouts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import spool
from tidewater.sinks import spool as S
from tidewater.sources import adapters as A


def test_batch_write_and_scan_round_trip(spark, tmpdir_path):
    rows = [("t", "d", "ndjson", b, i, 0, f"line {b}-{i}") for b in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "tenant_id string, dataset_id string, data_hint string, batch_no long, seq long, "
                                     "line_no long, line string")
    out = os.path.join(tmpdir_path, "batches")
    S.write_batches(df, out)
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(out) for f in fs if f.endswith(".gz")]
    assert len(files) == 3  # one gzip object per batch
    with open(files[0], "rb") as fh:
        assert fh.read(2) == b"\x1f\x8b"
    lines = A.scan_batches(spark, out)
    stats = A.batch_file_stats(lines).collect()
    assert sorted(r.line_count for r in stats) == [4, 4, 4]
    assert all(r.uncompressed_bytes == 4 * (len("line 0-0") + 1) for r in stats)
    listing = A.scan_spool(spark, out)
    assert listing.where(F.col("path").endswith(".gz")).count() == 3
    assert "content" not in listing.columns


@pytest.mark.parametrize("layout", ["flat", "tenant_dataset", "date_tenant", "protocol_tenant"])
def test_raw_layouts(spark, tmpdir_path, layout):
    df = spark.createDataFrame([(1, "t1", "d1", "x", "2024-03-04 05:06:07")],
                               "seq long, tenant_id string, dataset_id string, data string, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    out = os.path.join(tmpdir_path, layout)
    S.write_raw(df, out, layout)
    dirs = [dp for dp, _, fs in os.walk(out) if any(f.endswith(".parquet") for f in fs)]
    expect = {"flat": "", "tenant_dataset": "tenant_id=t1/dataset_id=d1",
              "date_tenant": "year=2024/month=03/day=04/tenant_id=t1/dataset_id=d1",
              "protocol_tenant": "protocol=data/tenant_id=t1/dataset_id=d1"}[layout]
    assert dirs[0].endswith(expect)
    with pytest.raises(ValueError):
        S.layout_columns("weird")


def test_metadata_scan_skips_dlq_and_corrupt(spark, tmpdir_path):
    for state, name, body in [("retry", "a.meta", {"id": "a", "tenant_id": "t", "retry_count": 2, "status": "retry"}),
                              ("dlq", "b.meta", {"id": "b", "tenant_id": "t", "status": "dlq"}),
                              ("retry", "c.meta", None)]:
        d = os.path.join(tmpdir_path, "t", "d", state)
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "w") as fh:
            fh.write(json.dumps(body) if body else "{not json")
        with open(os.path.join(d, name.replace(".meta", ".gz")), "wb") as fh:
            fh.write(b"\x1f\x8b")
    m = A.scan_metadata(spark, tmpdir_path).collect()
    assert [(r.id, r.retry_count) for r in m] == [("a", 2)]
    l = spool.with_path_parts(A.scan_spool(spark, tmpdir_path), root="file:" + tmpdir_path)
    assert sorted((r.state, r.is_meta) for r in l.collect()) == sorted(
        [("retry", True), ("retry", False), ("dlq", True), ("dlq", False), ("retry", True), ("retry", False)])


def test_control_document_reader(spark, tmpdir_path):
    from tidewater.operators import configs
    doc = {"tenants": [{"tenant": {"id": "t1", "name": "T1", "active": False},
                        "datasets": [{"id": "d1", "name": "D1", "active": True,
                                      "config": {"source": {"type": "udp", "custom": {"port": "9000", "host": "h"}}}},
                                     {"id": "d2", "name": "D2", "active": False, "config": {"source": {"type": "udp"}}},
                                     {"id": "d3", "name": "D3", "active": True, "config": {"source": {"type": ""}}}]}],
           "receivers": [{"instance_id": "r", "instance_api": "h:1", "max_payload_size": 5}]}
    p = os.path.join(tmpdir_path, "doc.json")
    with open(p, "w") as fh:
        json.dump(doc, fh, indent=2)
    docs = A.read_control_documents(spark, p)
    cfg = configs.expand_control_doc(A.control_to_doc(docs), bearer_token="tok").collect()
    assert len(cfg) == 1 and cfg[0].config["port"] == "9000" and cfg[0].config["host"] == "h"
    assert cfg[0].config["tenant_id"] == "t1"  # tenant active flag is not consulted
