"""Flow records (sFlow / IPFIX / NetFlow) to flat NDJSON rows (PAR-04..08).

These operators start from *decoded* packet structs (``flow_wire`` decodes
NetFlow v9 and IPFIX datagrams; sFlow comes from a collector) and do the
projection work:
flattening nested samples, decoding raw packet headers with binary
functions, dropping zero / empty fields and rendering addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import with_ip_text


def _number(hx: Column, pos: Column | int, size: int) -> Column:
    """The unsigned big-endian number of ``size`` bytes at 0-based ``pos`` of a
    hex string (NULL past the end)."""
    p = F.lit(pos) if isinstance(pos, int) else pos
    part = F.substring(hx, p * 2 + 1, F.lit(2 * size))
    return F.when(F.length(part) == 2 * size, F.conv(part, 16, 10).cast("long"))


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, bits).bitwiseAND(255).cast("string") for bits in (24, 16, 8, 0)])


def _header_offset(hx: Column) -> Column:
    n = F.length(hx) / 2
    ethertype = F.substring(hx, 25, 4)
    return F.when(n >= 14, F.when(ethertype == "0800", 14).when(F.substring(ethertype, 1, 2) == "45", 0).otherwise(14)).otherwise(0)


def with_decoded_header(df: DataFrame, header: Column, out: str = "hdr") -> DataFrame:
    """PAR-05: addresses and TCP/UDP ports from a raw sampled header.

    Offset: 14 when bytes 12-13 are the IPv4 ethertype, 0 when byte 12 is
    0x45, else 14 (headers shorter than 14 bytes start at 0). NULL unless
    20 header bytes follow the offset and the version nibble is 4. Ports
    need IHL + 4 bytes and protocol 6 or 17; zero ports are dropped.

    The hex form, the offset and each number are read once per row, in
    projections of their own.
    """
    hx, off = F.col("_hx"), F.col("_off")
    d = df.withColumn("_hx", F.hex(header))
    d = d.withColumn("_off", _header_offset(hx))
    d = d.withColumn("_ver", F.when(F.length(hx) / 2 >= off + 20, _number(hx, off, 1)))
    d = d.withColumn("_ver", F.when(F.shiftright("_ver", 4) == 4, F.col("_ver")))
    ver = F.col("_ver")
    transport = F.substring(hx, (off + 9) * 2 + 1, F.lit(2)).isin("06", "11")
    d = d.withColumns({"_src": F.when(ver.isNotNull(), _number(hx, off + 12, 4)),
                       "_dst": F.when(ver.isNotNull(), _number(hx, off + 16, 4)),
                       "_ports": F.when(ver.isNotNull() & transport, _number(hx, off + ver.bitwiseAND(15) * 4, 4))})
    sport, dport = F.shiftright("_ports", 16).cast("int"), F.col("_ports").bitwiseAND(65535).cast("int")
    fields = F.struct(_dotted(F.col("_src")).alias("src_ip"), _dotted(F.col("_dst")).alias("dst_ip"),
                      F.when(sport != 0, sport).alias("src_port"), F.when(dport != 0, dport).alias("dst_port"))
    return d.withColumn(out, F.when(ver.isNotNull(), fields)).drop("_hx", "_off", "_ver", "_src", "_dst", "_ports")


def flatten_sflow(packets: DataFrame) -> DataFrame:
    """PAR-04: one flat row per flow record, or one packet-level row when a
    packet carries no flow records. Records of other samples (counters) are
    not flows.

    Header records give protocol, frame length and the decoded header
    fields; decoded IPv4 / IPv6 records give their addresses, ports and
    protocol (expanded samples do not carry IPv6 records' fields). NULL
    fields are absent from the ``ndjson`` rendering.
    """
    flow = lambda s: s["kind"].isin("flow", "expanded")
    n_rec = F.aggregate(F.coalesce("samples", F.array()), F.lit(0),
                        lambda acc, s: acc + F.when(flow(s), F.greatest(F.size(s["records"]), F.lit(0))).otherwise(0))
    p = with_ip_text(packets.withColumn("n_records", n_rec), "agent_ip", "agent_txt")
    pkt = p.where(F.col("n_records") == 0).select(
        "packet_id", F.struct(
            F.col("version"), F.col("agent_txt").alias("agent_ip"), F.col("sequence_number"),
            F.size("samples").alias("samples_count")).alias("row"))
    s = p.where(F.col("n_records") > 0).select("packet_id", "version", F.col("agent_txt").alias("agent_ip"),
                                               F.explode(F.filter("samples", flow)).alias("s"))
    r = s.select("packet_id", "version", "agent_ip", "s.kind", "s.sampling_rate", "s.input_if", "s.output_if",
                 F.explode("s.records").alias("r"))
    r = with_decoded_header(r, F.col("r.header"), "hdr")
    r = with_ip_text(with_ip_text(r, "r.src_ip", "src_txt"), "r.dst_ip", "dst_txt")
    hdr = F.col("hdr")
    kind = F.col("r.kind")
    is_hdr, is4 = kind == "header", kind == "ipv4"
    is6 = (kind == "ipv6") & (F.col("kind") == "flow")
    rows = r.select("packet_id", F.struct(
        F.col("version"), F.col("agent_ip"), F.col("sampling_rate"),
        F.col("input_if"), F.col("output_if"),
        F.when(is_hdr | is4 | is6, F.col("r.protocol")).alias("protocol"),
        F.when(is_hdr, F.col("r.frame_length")).alias("frame_length"),
        F.when(is_hdr, hdr["src_ip"]).when(is4 | is6, F.col("src_txt")).alias("src_ip"),
        F.when(is_hdr, hdr["dst_ip"]).when(is4 | is6, F.col("dst_txt")).alias("dst_ip"),
        F.when(is_hdr, hdr["src_port"]).when(is4 | is6, F.col("r.src_port")).alias("src_port"),
        F.when(is_hdr, hdr["dst_port"]).when(is4 | is6, F.col("r.dst_port")).alias("dst_port"),
        F.col("r.lno").alias("lno"), F.col("r.pkey").alias("pkey"), F.col("r.skey").alias("skey"),
    ).alias("row"))
    return rows, pkt


def sflow_ndjson(packets: DataFrame) -> DataFrame:
    """PAR-04 output lines: flow rows and packet rows as compact JSON."""
    rows, pkt = flatten_sflow(packets)
    f = rows.select("packet_id", F.to_json(F.col("row").dropFields("lno", "pkey", "skey")).alias("ndjson"))
    return f.unionByName(pkt.select("packet_id", F.to_json("row").alias("ndjson")))


# IPFIX flow-message fields in output order, with the kind of
# emptiness test each uses (number > 0, bytes/array non-empty, address).
IPFIX_FIELDS = (
    ("TimeReceivedNs", "num"), ("TimeFlowStartNs", "num"), ("TimeFlowEndNs", "num"), ("SequenceNum", "num"),
    ("SamplingRate", "num"), ("SamplerAddress", "addr"), ("SrcAddr", "addr"), ("DstAddr", "addr"),
    ("Bytes", "num"), ("Packets", "num"), ("Etype", "num"), ("Proto", "num"), ("SrcPort", "num"),
    ("DstPort", "num"), ("InIf", "num"), ("OutIf", "num"), ("SrcMac", "num"), ("DstMac", "num"),
    ("SrcVlan", "num"), ("DstVlan", "num"), ("VlanId", "num"), ("IpTos", "num"), ("IpTtl", "num"),
    ("IpFlags", "num"), ("TcpFlags", "num"), ("Ipv6FlowLabel", "num"), ("IcmpType", "num"), ("IcmpCode", "num"),
    ("FragmentId", "num"), ("FragmentOffset", "num"), ("SrcAs", "num"), ("DstAs", "num"), ("NextHop", "addr"),
    ("NextHopAs", "num"), ("SrcNet", "num"), ("DstNet", "num"), ("BgpNextHop", "addr"),
    ("BgpCommunities", "list"), ("AsPath", "list"), ("ObservationDomainId", "num"),
    ("ObservationPointId", "num"), ("ForwardingStatus", "num"),
)


def ipfix_rows(packets: DataFrame, flows: str = "flows") -> DataFrame:
    """PAR-06/07: one row per flow message (template-only packets, i.e. an
    empty flow list, give none); ``Type`` always, every other field only
    when non-zero / non-empty, addresses rendered as text."""
    f = packets.select("packet_id", F.explode(flows).alias("f"))
    present = set(f.schema["f"].dataType.fieldNames())
    for name, kind in IPFIX_FIELDS:
        if kind == "addr" and name in present:
            f = with_ip_text(f, f"f.{name}", f"_txt_{name}")
    cols = [F.col("f.Type").alias("Type")]
    for name, kind in IPFIX_FIELDS:
        if name not in present:
            continue
        c = F.col(f"f.{name}")
        if kind == "num":
            cols.append(F.when(c > 0, c).alias(name))
        elif kind == "addr":
            cols.append(F.when(F.octet_length(c) > 0, F.col(f"_txt_{name}")).alias(name))
        else:
            cols.append(F.when(F.size(c) > 0, c).alias(name))
    return f.select("packet_id", F.struct(*cols).alias("row"))


def ipfix_ndjson(packets: DataFrame) -> DataFrame:
    """PAR-06 output lines (NULL fields dropped by ``to_json``)."""
    return ipfix_rows(packets).select("packet_id", F.to_json("row").alias("ndjson"))


def netflow_ndjson(packets: DataFrame) -> DataFrame:
    """PAR-08: one JSON line per decoded NetFlow v9 packet."""
    cols = [c for c in packets.columns if c != "packet_id"]
    return packets.select("packet_id", F.to_json(F.struct(*cols)).alias("ndjson"))
