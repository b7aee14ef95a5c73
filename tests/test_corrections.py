"""Inputs that the fixtures do not hold."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import admission, configs, delivery, flows, framing
from tidewater.plans import ingest
from tidewater.sources import adapters as A

TS = dt.datetime(2024, 1, 1)


def test_cut_inside_a_character(spark):
    df = spark.createDataFrame([(1, "POST", {"authorization": "Bearer s"}, 3, "aé\nz")],
                               "seq long, method string, headers map<string,string>, declared_length long, body string")
    r = admission.admit_requests(df, bearer_token="s", max_payload=2, max_lines=1).collect()[0]
    assert (r.code, bytes(r.body)) == (413, b"a\xc3")
    r = admission.admit_requests(df, bearer_token="s", max_payload=3, max_lines=1).collect()[0]
    assert (r.code, bytes(r.body)) == (200, "aé".encode())
    r = admission.admit_requests(df, bearer_token="s", max_lines=1).collect()[0]
    assert r.code == 413


def test_headers_in_any_case(spark):
    df = spark.createDataFrame([(1, "POST", {"x-request-id": "7", "content-TYPE": "t", "X-Up": "u"}, "é", "/", "ip", TS)],
                               "seq long, method string, headers map<string,string>, body string, path string, remote_addr string, ts timestamp_ntz")
    m = A.http_to_messages(df, "t", "d", data_format="text").collect()[0]
    assert (m.metadata["header_x-request-id"], m.metadata["content_type"], m.metadata["header_x-up"]) == ("7", "t", "u")
    assert m.data_format == "text"
    cut = A.http_to_messages(df.withColumn("body", F.substring(F.col("body").cast("binary"), 1, 1)), "t", "d").collect()[0]
    assert cut.data == "�"


def test_counter_samples_are_no_flows(spark):
    rec = ("kind string, protocol int, frame_length int, header binary, src_ip binary, dst_ip binary, src_port int, dst_port int, "
           "lno int, pkey int, skey int, qty int")
    schema = (f"packet_id long, version int, agent_ip binary, sequence_number long, samples array<struct<kind string, sampling_rate int, "
              f"input_if int, output_if int, records array<struct<{rec.replace(' string', ': string').replace(' int', ': int').replace(' binary', ': binary')}>>>>")
    schema = schema.replace("kind string, sampling_rate int, input_if int, output_if int, records array",
                            "kind: string, sampling_rate: int, input_if: int, output_if: int, records: array")
    r = ("other", None, None, None, None, None, None, None, 1, 1, 1, 1)
    ip = bytes([10, 0, 0, 1])
    df = spark.createDataFrame([(1, 5, ip, 1, [("counter", 1, 1, 1, [r, r])]), (2, 5, ip, 2, [("counter", 1, 1, 1, [r]), ("flow", 1, 1, 1, [r])]),
                                (3, 5, ip, 3, [])], schema)
    rows, packets = flows.flatten_sflow(df)
    assert [x.packet_id for x in rows.collect()] == [2]
    assert sorted(x.packet_id for x in packets.collect()) == [1, 3]


def test_repeated_ports(spark):
    ports = spark.createDataFrame([(1, 80, "a"), (2, 80, "b"), (3, 90, "c")], "pos long, port int, plugin string")
    remote = spark.createDataFrame([(1, 80, "r")], "pos long, port int, plugin string")
    assert [(r.port, r.local_plugin) for r in configs.port_conflicts(ports, remote).collect()] == [(80, "b")]
    assert sorted((r.port, r.change) for r in configs.port_changes(ports, remote).collect()) == [(80, "reassigned"), (90, "removed")]
    cfg = spark.createDataFrame([(1, "udp", "x", {"port": "5", "dataset_id": "one", "tenant_id": "t"}),
                                 (2, "udp", "y", {"port": "5", "dataset_id": "two", "tenant_id": "t"}),
                                 (3, "http", "z", {"port": "6", "dataset_id": "web"})],
                                "pos long, type string, name string, config map<string,string>")
    counters = spark.createDataFrame([(5, 1), (6, 1)], "port int, drops int")
    got = configs.attribute_ports(counters, configs.port_datasets(cfg)).collect()
    assert sorted((r.port, r.tenant_id, r.dataset_id) for r in got) == [(5, "t", "two"), (6, None, "unknown")]
    assert [(r.port, r.plugin) for r in configs.config_ports(cfg).orderBy("pos").collect()] == [(5, "udp[x]"), (5, "udp[y]"), (6, "http[z]")]


def test_files_without_an_attempt_stay(spark):
    f = spark.createDataFrame([("f", 1, "t", "d", s, 2, "why") for s in ("queue", "retry")],
                              "id string, okey int, tenant_id string, dataset_id string, state string, retry_count int, trigger_reason string")
    none = spark.createDataFrame([], "okey int, status_code int, ts timestamp")
    q = delivery.queue_step(f, none).collect()[0]
    assert (q.new_state, q.retry_count, q.failure_reason, q.trigger_reason) == ("queue", 2, None, "why")
    r = delivery.retry_step(f, none).collect()[0]
    assert (r.new_state, r.retry_count, r.failure_reason) == ("retry", 2, None)


def test_null_payload_and_null_keys(spark):
    t = spark.createDataFrame([(1, " null "), (2, "[1]"), (3, "nil")], "id int, data string")
    assert [r.out for r in framing.telemetry_accept(t).orderBy("id").collect()] == ["null", None, None]
    m = spark.createDataFrame([(1, None, "d", "plain\n{}"), (2, None, "d", "{}"), (3, "t", "d", "{}")],
                              "seq long, tenant_id string, dataset_id string, data string") \
        .withColumns({"input": F.lit("i"), "data_format": F.lit(""), "data_hint": F.lit("raw"),
                      "ts": F.lit(TS).cast("timestamp_ntz"), "source_ip": F.lit("x")})
    got = {(r.seq, r.line): r.wrapped for r in ingest.land_lines(m).collect()}
    assert got == {(1, "plain"): True, (1, "{}"): True, (2, "{}"): True, (3, "{}"): False}


def test_adapters_feed_the_landing_plan(spark):
    k = spark.createDataFrame([("s1", 5, '{"a":1}\n{"a":2}', TS)], "shard_id string, sequence_number long, data string, ts timestamp")
    m = A.kinesis_to_messages(k.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "t", "d", hint="ndjson")
    assert set(A.MESSAGE_SCHEMA.fieldNames()) == set(m.columns)
    assert [r.wrapped for r in ingest.land_lines(m).collect()] == [False, False]
