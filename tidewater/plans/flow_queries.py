"""Queries for flow-record projection (PAR-04..08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.naming import with_ip_text
from ..operators import flow_wire, flows
from ..sources import fixtures as fx
from .catalog import register
from .oracle_fixtures import with_fixtures

_SFLOW_COLS = ("version", "agent_ip", "sampling_rate", "input_if", "output_if", "protocol", "frame_length",
               "src_ip", "dst_ip", "src_port", "dst_port")


@register("par04_sflow_flatten", with_fixtures("""
SELECT packet_id, lno, pkey, skey, CAST(version AS INT) AS version, agent_ip, CAST(sampling_rate AS INT) AS sampling_rate,
  CAST(input_if AS INT) AS input_if, CAST(output_if AS INT) AS output_if, CAST(protocol AS INT) AS protocol,
  CAST(frame_length AS INT) AS frame_length, src_ip, dst_ip, CAST(src_port AS INT) AS src_port, CAST(dst_port AS INT) AS dst_port
FROM sflow_expected"""))
def q_sflow_flatten(spark, sf):
    """PAR-04 + PAR-05 + PRJ-10: flow rows of sFlow packets (header decode,
    IPv4 / IPv6 records, expanded samples)."""
    rows, _ = flows.flatten_sflow(fx.flow_packets(spark, sf))
    r = rows.select("packet_id", "row.*")
    return r.select("packet_id", "lno", "pkey", "skey", *[F.col(c).cast("int").alias(c) if c not in ("agent_ip", "src_ip", "dst_ip")
                                                          else F.col(c) for c in _SFLOW_COLS])


@register("par04_sflow_packets", """
SELECT o_orderkey AS packet_id, '10.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || '.1' AS agent_ip,
  o_orderkey AS sequence_number, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS samples_count
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def q_sflow_packets(spark, sf):
    """PAR-04: packet-level rows for packets without flow records."""
    _, pkt = flows.flatten_sflow(fx.flow_packets(spark, sf))
    return pkt.select("packet_id", "row.agent_ip", "row.sequence_number", F.col("row.samples_count").cast("int").alias("samples_count"))


@register("par06_ipfix", """
SELECT l_orderkey AS packet_id, l_linenumber AS lno, l_partkey AS pkey, 'IPFIX' AS "Type",
  CAST(CASE WHEN l_partkey % 2 = 1 THEN 100 END AS BIGINT) AS "SamplingRate", '10.0.0.1' AS "SamplerAddress",
  CASE l_linenumber % 3 WHEN 0 THEN '10.0.' || (l_partkey % 256) || '.' || (l_suppkey % 256)
       WHEN 1 THEN CASE WHEN l_partkey % 65536 = 0 THEN '2001:db8::' ELSE '2001:db8::' || lower(printf('%x', l_partkey % 65536)) END END AS "SrcAddr",
  '192.168.' || (l_orderkey % 256) || '.1' AS "DstAddr",
  CAST(round(l_extendedprice) AS BIGINT) AS "Bytes", CAST(l_quantity AS BIGINT) AS "Packets",
  CAST(CASE WHEN l_linenumber % 3 = 1 THEN 34525 ELSE 2048 END AS BIGINT) AS "Etype",
  CAST(CASE l_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 END AS BIGINT) AS "Proto",
  CASE WHEN l_partkey % 3 <> 2 AND l_partkey % 65536 <> 0 THEN l_partkey % 65536 END AS "SrcPort",
  CAST(CASE WHEN l_suppkey % 5 <> 0 THEN 443 END AS BIGINT) AS "DstPort",
  CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey % 10 END AS "InIf",
  CASE WHEN l_suppkey % 3 <> 0 THEN (l_suppkey % 3) * 64512 END AS "SrcAs",
  CASE WHEN l_partkey % 4 <> 0 THEN '10.0.0.254' END AS "NextHop",
  CASE WHEN l_suppkey % 2 = 1 THEN CAST(l_suppkey AS VARCHAR) END AS "BgpCommunities",
  CASE WHEN l_partkey % 5 <> 0 THEN '64512,65000' END AS "AsPath",
  CAST(CASE WHEN l_linenumber = 1 THEN 64 END AS BIGINT) AS "ForwardingStatus"
FROM lineitem WHERE l_orderkey % 9 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def q_ipfix(spark, sf):
    """PAR-06 + PAR-07: IPFIX flow rows, zero / empty fields dropped,
    template-only packets yield nothing."""
    r = fx.ipfix_packets(spark, sf).select("packet_id", F.explode("flows").alias("f")).select(
        "packet_id", F.col("f._lno").alias("lno"), F.col("f._pkey").alias("pkey"), F.array("f").alias("flows"))
    out = flows.ipfix_rows(r.select("packet_id", "lno", "pkey", "flows").withColumn(
        "packet_id", F.struct("packet_id", "lno", "pkey")))
    o = out.select(F.col("packet_id.packet_id").alias("packet_id"), F.col("packet_id.lno").alias("lno"),
                   F.col("packet_id.pkey").alias("pkey"), "row.*")
    return o.select("packet_id", "lno", "pkey", "Type", "SamplingRate", "SamplerAddress", "SrcAddr", "DstAddr", "Bytes",
                    "Packets", "Etype", "Proto", "SrcPort", "DstPort", "InIf", "SrcAs", "NextHop",
                    F.array_join(F.col("BgpCommunities").cast("array<string>"), ",").alias("BgpCommunities"),
                    F.array_join(F.col("AsPath").cast("array<string>"), ",").alias("AsPath"), "ForwardingStatus")


@register("par07_ipfix_lines", """
SELECT l_orderkey AS packet_id, count(*) AS flow_lines, count(*) AS typed FROM lineitem
WHERE l_orderkey % 9 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def q_ipfix_lines(spark, sf):
    """PAR-07: one NDJSON line per flow message (template-only: none)."""
    lines = flows.ipfix_ndjson(fx.ipfix_packets(spark, sf))
    return lines.groupBy("packet_id").agg(F.count(F.lit(1)).alias("flow_lines"), F.count_if(
        F.get_json_object("ndjson", "$.Type") == "IPFIX").alias("typed"))


@register("par08_netflow", """
SELECT o_orderkey AS packet_id, 9 AS version, CAST(count(l_orderkey) AS INT) AS count, o_orderkey AS sequence_number,
  CAST(o_custkey % 16 AS BIGINT) AS source_id, CAST(CASE WHEN count(l_orderkey) > 0 THEN 1 ELSE 0 END AS INT) AS flowsets
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def q_netflow(spark, sf):
    """PAR-08: one JSON line per decoded NetFlow v9 packet (fields read back)."""
    j = flows.netflow_ndjson(fx.netflow_packets(spark, sf)).select("packet_id", "ndjson")
    g = lambda p, t: F.get_json_object("ndjson", p).cast(t)
    return j.select("packet_id", g("$.Version", "int").alias("version"), g("$.Count", "int").alias("count"),
                    g("$.SequenceNumber", "long").alias("sequence_number"), g("$.SourceId", "long").alias("source_id"),
                    F.json_array_length(F.get_json_object("ndjson", "$.FlowSets")).alias("flowsets"))


_DOTTED = "({0} >> 24) || '.' || (({0} >> 16) & 255) || '.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"


@register("par06_wire_flows", with_fixtures(f"""
SELECT doc_id AS packet_id, record_no, CASE WHEN v9 THEN 'NETFLOW_V9' ELSE 'IPFIX' END AS "Type", exporter AS "SamplerAddress",
  sampling AS "SamplingRate", nullif(doc_id, 0) AS "SequenceNum", nullif(domain, 0) AS "ObservationDomainId",
  CASE layout WHEN 0 THEN {_DOTTED.format("w0")} ELSE {_DOTTED.format("w1")} END AS "SrcAddr",
  CASE layout WHEN 0 THEN {_DOTTED.format("w1")} ELSE {_DOTTED.format("w0")} END AS "DstAddr",
  nullif(CASE layout WHEN 0 THEN w2 ELSE w3 END >> 16, 0) AS "SrcPort", nullif(CASE layout WHEN 0 THEN w2 ELSE w3 END & 65535, 0) AS "DstPort",
  nullif(CASE layout WHEN 0 THEN w3 ELSE w2 END, 0) AS "Bytes"
FROM wire_words"""))
def q_wire_flows(spark, sf):
    """PAR-06 from the wire: flow rows of NetFlow v9 and IPFIX datagrams under
    the templates and sampling rates in force."""
    found = flow_wire.messages(flow_wire.records(fx.datagrams(spark, sf)))
    return flows.ipfix_rows(found).select(
        "packet_id.packet_id", F.col("packet_id.record_no").cast("long").alias("record_no"),
        *[f"row.{c}" for c in ("Type", "SamplerAddress", "SamplingRate", "SequenceNum", "ObservationDomainId", "SrcAddr",
                               "DstAddr", "SrcPort", "DstPort", "Bytes")])


@register("par08_wire_packets", with_fixtures("""
SELECT doc_id AS packet_id, 1 + n % 23 + CASE WHEN told IS NULL THEN 0 ELSE 1 END + CASE WHEN rate IS NULL THEN 0 ELSE 2 END AS count,
  doc_id AS sequence_number, domain AS source_id, CASE WHEN layout IS NULL THEN 0 ELSE 1 END + CASE WHEN rate IS NULL THEN 0 ELSE 1 END AS flowsets,
  rate AS first_rate
FROM wire_packets WHERE v9 AND error IS NULL"""))
def q_wire_packets(spark, sf):
    """PAR-08 from the wire: one JSON line per NetFlow v9 datagram (read back)."""
    j = flows.netflow_ndjson(flow_wire.netflow_packets(fx.datagrams(spark, sf)))
    g = lambda p, t: F.get_json_object("ndjson", p).cast(t)
    told = F.unbase64(F.get_json_object("ndjson", "$.FlowSets[0].Records[0].Values[1].Value"))
    is_rate = F.get_json_object("ndjson", "$.FlowSets[0].Id") == "301"
    return j.select("packet_id", g("$.Count", "long").alias("count"), g("$.SequenceNumber", "long").alias("sequence_number"),
                    g("$.SourceId", "long").alias("source_id"),
                    F.json_array_length(F.get_json_object("ndjson", "$.FlowSets")).cast("long").alias("flowsets"),
                    F.when(is_rate, F.conv(F.hex(told), 16, 10).cast("long")).alias("first_rate"))


@register("par06_wire_outcomes", with_fixtures("""
SELECT exporter, coalesce(error, 'sound') AS outcome, count(*) AS packets,
  count(*) FILTER (error IS NULL AND layout IS NULL) AS unresolved_sets
FROM wire_packets GROUP BY ALL"""))
def q_wire_outcomes(spark, sf):
    """Datagrams per exporter that decode or not, and why; data sets that came
    before their template."""
    heads = flow_wire.packets(fx.datagrams(spark, sf))
    sets = flow_wire.resolved_sets(flow_wire.sets(heads)).where("template IS NULL")
    lost = sets.select("exporter", F.lit("sound").alias("outcome"), F.lit(0).alias("packets"), F.lit(1).alias("unresolved"))
    both = heads.select("exporter", F.coalesce("error", F.lit("sound")).alias("outcome"), F.lit(1).alias("packets"),
                        F.lit(0).alias("unresolved")).unionByName(lost)
    sums = both.groupBy("exporter", "outcome").agg(F.sum("packets").alias("packets"), F.sum("unresolved").alias("unresolved_sets"))
    return with_ip_text(sums, "exporter", "_text").select(F.col("_text").alias("exporter"), "outcome", "packets", "unresolved_sets")
