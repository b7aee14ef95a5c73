"""Flow datagrams against a decoder written with ``struct``."""

import random
import struct

import pytest

from tidewater.operators import flow_wire as W
from tidewater.operators import flows

SCHEMA = "packet_id long, exporter binary, received long, payload binary"


def sent(sets):
    return b"".join(struct.pack(">HH", i, len(b) + 4) + b for i, b in sets)


def v9(sets, count=99, domain=7, seq=1, secs=1000, uptime=5000):
    return struct.pack(">HHIIII", 9, count, uptime, secs, seq, domain) + sent(sets)


def v10(sets, domain=7, seq=1, secs=1000):
    body = sent(sets)
    return struct.pack(">HHIII", 10, 16 + len(body), secs, seq, domain) + body


def plain(template, *fields):
    return struct.pack(f">{2 + 2 * len(fields)}H", template, len(fields), *[x for f in fields for x in f])


def brute(rows):
    """{(packet, set, record): {element: bytes}} by reading byte after byte."""
    cache, out = {}, {}
    for packet, exporter, received, data in sorted(rows, key=lambda r: (r[2], r[0])):
        version, second = struct.unpack(">HH", data[:4])
        at = 20 if version == 9 else 16
        domain = data[at - 4:at]
        found, number, left = [], 0, second
        while at + 4 <= len(data) and (version == 10 or left):
            set_id, size = struct.unpack(">HH", data[at:at + 4])
            found.append((number, set_id, data[at + 4:at + size]))
            at, number, left = at + size, number + 1, left - 1
        for number, set_id, body in found:
            key = (exporter, version, domain, set_id)
            if set_id < 256:
                at = 0
                while at + 4 <= len(body):
                    name, count = struct.unpack(">HH", body[at:at + 4])
                    if name < 256:
                        break
                    at, fields = at + 4, []
                    for _ in range(count):
                        element, size = struct.unpack(">HH", body[at:at + 4])
                        at += 4
                        if version == 10 and element >= 32768:
                            element = struct.unpack(">I", body[at:at + 4])[0] * 65536 + element - 32768
                            at += 4
                        fields.append((element, size))
                    cache[exporter, version, domain, name] = fields
            elif cache.get(key):
                at, record = 0, 0
                least = sum(1 if n == 65535 else n for _, n in cache[key])
                while at + least <= len(body):
                    values = {}
                    for element, size in cache[key]:
                        if size == 65535:
                            size, at = body[at], at + 1
                            if size == 255:
                                size, at = struct.unpack(">H", body[at:at + 2])[0], at + 2
                        values[element], at = body[at:at + size], at + size
                    out[packet, number, record] = values
                    record += 1
    return out


def test_random_datagrams_match_a_byte_reader(spark):
    rnd = random.Random(5)
    rows, layouts = [], {}
    for packet in range(300):
        exporter, version, domain = rnd.choice([b"\x0a\0\0\1", b"\x0a\0\0\2"]), rnd.choice([9, 10]), rnd.randrange(2)
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            name = rnd.randrange(256, 259)
            key = exporter, version, domain, name
            if rnd.random() < 0.3:
                fields = [(e, rnd.choice([1, 2, 4, 8] + [65535] * (version == 10))) for e in rnd.sample(range(1, 60), rnd.randrange(1, 5))]
                layouts[key] = fields
                body = struct.pack(">HH", name, len(fields))
                for n, (element, size) in enumerate(fields):
                    if version == 10 and n == 1:
                        fields[n] = element + 9 * 65536, size
                        body += struct.pack(">HHI", element + 32768, size, 9)
                    else:
                        body += struct.pack(">HH", element, size)
                parts.append((0 if version == 9 else 2, body))
            else:
                body = b""
                for _ in range(rnd.randrange(4)):
                    for _, size in layouts.get(key, [(1, 4)]):
                        if size == 65535:
                            size = rnd.choice([0, 3, 254, 255, 300])
                            body += bytes([size]) if size < 255 else b"\xff" + struct.pack(">H", size)
                        body += rnd.randbytes(size)
                parts.append((name, body))
        make = v9 if version == 9 else v10
        rows.append((packet, exporter, packet // 2, make(parts, domain=domain)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.packet_id, r.set_no, r.record_no): {k: bytes(v) for k, v in r["values"].items()} for r in W.records(df).collect()}
    want = brute(rows)
    assert len(want) > 200 and got == want


def test_errors_and_padding(spark):
    layout = plain(256, (8, 4), (7, 2))
    good = v9([(0, layout), (256, b"\x0a\0\0\1\0\x50" + b"\0\0")], 2)
    rows = [(1, b"\1", 1, good), (2, b"\1", 2, None), (3, b"\1", 3, b""), (4, b"\1", 4, b"\0\x05" + good[2:]),
            (5, b"\1", 5, good[:-3]), (6, b"\1", 6, good[:18]), (7, b"\1", 7, v10([(2, layout)])[:-1]),
            (8, b"\1", 8, v9([], 0)), (9, None, 9, good), (10, b"\1", 10, v9([(256, b"\0" * 5)], 1)),
            (11, b"\1", 11, v9([(0, layout[:-2])], 1)), (12, b"\1", 12, struct.pack(">HHIIIIHH", 9, 3, 0, 0, 0, 7, 256, 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    errors = {r.packet_id: r.error for r in W.packets(df).collect()}
    assert errors == {1: None, 2: "version", 3: "version", 4: "version", 5: "set length", 6: "short", 7: "short",
                      8: None, 9: None, 10: None, 11: None, 12: "set length"}
    assert [(r.packet_id, r.record_no) for r in W.records(df).orderBy("packet_id").collect()] == [(1, 0), (9, 0)]
    assert W.records(df.limit(0)).count() == 0
    # Columns of the input that bear names of the decoder's own are not read.
    odd = df.selectExpr("*", "'x' AS version", "1 AS domain", "'y' AS template", "2 AS _walk")
    assert W.records(odd).count() == 2


def test_template_in_force_changes_and_is_withdrawn(spark):
    four, two = plain(256, (1, 4)), plain(256, (1, 2))
    data = (256, b"\0\0\0\1")
    rows = [(1, b"\1", 1, v10([data])), (2, b"\1", 2, v10([(2, four)])), (3, b"\1", 3, v10([data])),
            (4, b"\1", 4, v10([data, (2, two), data])), (5, b"\1", 5, v10([(2, plain(256)), data])),
            (6, b"\1", 6, v10([data])), (7, b"\1", 7, v10([(2, four), data])), (8, b"\2", 8, v10([data])),
            (9, b"\1", 9, v10([data], domain=8)), (10, b"\1", 10, v9([data]))]
    found = W.records(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = sorted((r.packet_id, r.set_no, r.record_no, len(r["values"][1])) for r in found)
    assert sizes == [(3, 0, 0, 4), (4, 0, 0, 4), (4, 2, 0, 2), (4, 2, 1, 2), (7, 1, 0, 4)]
    lost = W.resolved_sets(W.sets(W.packets(spark.createDataFrame(rows, SCHEMA)))).where("template IS NULL")
    assert sorted(r.packet_id for r in lost.collect()) == [1, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("version", [9, 10])
def test_sampling_rate_of_options(spark, version):
    make, plain_set, option_set = (v9, 0, 1) if version == 9 else (v10, 2, 3)
    option = struct.pack(">7H", 257, 4, 4, 1, 4, 34, 4) if version == 9 else struct.pack(">7H", 257, 2, 1, 130, 4, 34, 4)
    flow = plain(256, (8, 4), (1, 4))
    told = lambda rate: (257, struct.pack(">II", 1, rate))
    data = (256, b"\x0a\0\0\1\0\0\1\0")
    rows = [(1, b"\x0a\0\0\2", 1, make([(plain_set, flow), (option_set, option), data])),
            (2, b"\x0a\0\0\2", 2, make([data, told(500)])), (3, b"\x0a\0\0\2", 3, make([data])),
            (4, b"\x0a\0\0\2", 4, make([told(0x7FFFFFFF), data])), (5, b"\x0a\0\0\3", 5, make([data]))]
    found = W.messages(W.records(spark.createDataFrame(rows, SCHEMA)))
    got = {r.packet_id.packet_id: r.row.SamplingRate for r in flows.ipfix_rows(found).collect()}
    assert got == {1: None, 2: 500, 3: 500, 4: 0x7FFFFFFF}


def test_messages_read_times_addresses_and_odd_sizes(spark):
    six = bytes.fromhex("20010db8" + "00" * 11 + "01")
    layout = [(27, 16), (12, 4), (21, 4), (22, 4), (32, 2), (1, 8), (2, 12), (4, 1), (7, 3)]
    body = six + b"\xc0\xa8\0\1" + struct.pack(">IIH", 4000, 3000, 0x0803) + b"\xff" * 8 + b"\xff" * 12 + b"\x11" + b"\0\1\xbb"
    clock = [(150, 8), (153, 8), (154, 8), (8, 0)]
    late = b"\xff" * 8 + struct.pack(">Q", 2000) + struct.pack(">II", 2208988800 + 5, 1 << 31)
    ntp = [(156, 8), (34, 2)]
    rows = [(1, b"\x0a\0\0\1", 1, v9([(0, plain(256, *layout)), (256, body)])),
            (2, b"\x0a\0\0\1", 2, v10([(2, plain(256, *clock)), (256, late)])),
            (3, b"\x0a\0\0\1", 3, v10([(2, plain(257, *ntp)), (257, struct.pack(">IIH", 2208988800 + 5, 1 << 31, 64))]))]
    found = flows.ipfix_rows(W.messages(W.records(spark.createDataFrame(rows, SCHEMA)))).collect()
    a, b, c = (r.row for r in sorted(found, key=lambda r: r.packet_id.packet_id))
    assert (a.Type, a.SrcAddr, a.DstAddr, a.SamplerAddress) == ("NETFLOW_V9", "2001:db8::1", "192.168.0.1", "10.0.0.1")
    # The exporter's clock was at 1,000 s with an uptime of 5 s.
    assert (a.TimeFlowStartNs, a.TimeFlowEndNs) == (998_000_000_000, 999_000_000_000)
    assert (a.IcmpType, a.IcmpCode, a.Proto, a.SrcPort, a.Bytes, a.Packets) == (8, 3, 17, 443, None, None)
    # Seconds that no 64-bit time holds give way to the next clock.
    assert (b.Type, b.TimeFlowStartNs, b.TimeFlowEndNs, b.SrcAddr) == ("IPFIX", 5_500_000_000, 2_000_000_000, None)
    assert (c.TimeFlowStartNs, c.SamplingRate) == (5_500_000_000, 64)


def test_netflow_packets_keep_their_sets(spark):
    rows = [(1, b"\1", 1, v9([(0, plain(256, (8, 4))), (256, b"\0\0\0\1\0\0\0\2")], 3, seq=11)),
            (2, b"\1", 2, v9([(300, b"\0\0\0\1"), (256, b"\0\0\0\3")], 2, seq=12)), (3, b"\1", 3, v10([(256, b"\0\0\0\1")]))]
    got = {r.packet_id: r for r in W.netflow_packets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2]
    assert [[v.Value for r in s.Records for v in r["Values"]] for s in got[1].FlowSets] == [["AAAAAQ==", "AAAAAg=="]]
    assert (got[2].Count, got[2].SequenceNumber, [s.Id for s in got[2].FlowSets]) == (2, 12, [256])
