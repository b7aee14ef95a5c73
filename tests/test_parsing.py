"""Syslog parsing, flow header decoding, record adapters."""

from pyspark.sql import functions as F

from tidewater.functions import syslog as S
from tidewater.operators import flows
from tidewater.sources import adapters as A


def _parse(spark, lines, mode="auto"):
    df = spark.createDataFrame([(l,) for l in lines], "v string")
    return [r.p for r in S.with_syslog(df, "v", "p", mode).collect()]


def test_syslog_rules(spark):
    r = _parse(spark, [
        "<34>1 2024-01-01T00:00:00Z host app 12 ID1 [ex@1 a=\"b\"] hello world",
        "<34>1 2024-01-01T00:00:00Z host app 12 ID1 - hello",
        "<13>Jan  5 10:00:00 myhost sshd[22]: Accepted\r key",
        "<13>Jan  5 10:00:00 myhost sshd: line one\nline two",
        "no syslog here",
    ])
    assert (r[0].rfc, r[0].hostname, r[0].message) == ("5424", "host", "hello world")
    assert (r[1].rfc, r[1].message) == ("5424", "- hello")  # '-' as structured data stays in the message
    assert (r[2].rfc, r[2].tag, r[2].message) == ("3164", "sshd[22]", "Accepted\r key")
    assert r[3].rfc == "raw"  # interior line break
    assert (r[4].rfc, r[4].message, r[4].priority) == ("raw", "no syslog here", None)
    only5424 = _parse(spark, ["<13>Jan  5 10:00:00 myhost sshd: x"], "rfc5424")
    assert only5424[0].rfc == "raw"


def _hdr(spark, hexes):
    df = spark.createDataFrame([(h,) for h in hexes], "h string")
    return [r.hdr for r in flows.with_decoded_header(df, F.unhex("h")).collect()]


ETH = "AABBCCDDEEFF112233445566"


def test_header_decode_cases(spark):
    ip_tcp = "4500005400004000" + "4006" + "0000" + "0A000001" + "C0A80102" + "1F90" + "01BB"
    ip_opts_udp = "4600005400004000" + "4011" + "0000" + "0A000001" + "C0A80102" + "01010101" + "0035" + "0000"
    ip_icmp = "4500005400004000" + "4001" + "0000" + "0A000001" + "C0A80102" + "0800" + "0000"
    r = _hdr(spark, [ETH + "0800" + ip_tcp, ETH + "0800" + ip_opts_udp, ETH + "0800" + ip_icmp,
                     (ETH + "0800" + ip_tcp)[:38], ETH + "86DD" + "60" + "00" * 39])
    assert (r[0].src_ip, r[0].dst_ip, r[0].src_port, r[0].dst_port) == ("10.0.0.1", "192.168.1.2", 8080, 443)
    assert (r[1].src_port, r[1].dst_port) == (53, None)  # IHL 6; zero port dropped
    assert (r[2].src_port, r[2].dst_port) == (None, None)  # ICMP: no ports
    assert r[3] is None and r[4] is None  # 19 bytes; not IPv4


def test_tcp_frames(spark):
    df = spark.createDataFrame([(1, "a\nb\x00\n\n  c  \ntail"), (2, "x||y|z")], "id long, stream string")
    got = [(r.id, r.frame) for r in A.tcp_frames(df.where("id = 1")).orderBy("frame_no").collect()]
    assert got == [(1, "a"), (1, "b"), (1, "c")]  # unterminated tail dropped
    got2 = [r.frame for r in A.tcp_frames(df.where("id = 2"), delimiter="||").orderBy("frame_no").collect()]
    assert got2 == ["x", "y"]  # cut on the first delimiter character only


def test_multipart_and_datagram(spark):
    df = spark.createDataFrame([(["topic", "payload"], "SUB"), (["only"], "SUB"), (["p1", "p2"], "PULL")],
                               "parts array<string>, t string")
    assert [r[0] for r in df.select(A.multipart_payload(F.col("parts"), F.col("t"))).collect()] == ["payload", "only", "p1"]
    d = spark.createDataFrame([("\x00\x00abc\x00",), ("\x00",)], "v string")
    assert [r[0] for r in d.select(A.datagram_payload(F.col("v"))).collect()] == ["abc", None]


def test_http_metadata(spark):
    df = spark.createDataFrame([(1, "POST", "/x", {"X-Trace": "t", "Content-Type": "a/b", "x-lower": "no"}, "body", "1.2.3.4",
                                 None)], "seq long, method string, path string, headers map<string,string>, body string, "
                                         "remote_addr string, ts timestamp_ntz")
    md = A.http_to_messages(df, "t", "d").first().metadata
    assert md["header_x-trace"] == "t" and md["content_type"] == "a/b" and "header_x-lower" in md
