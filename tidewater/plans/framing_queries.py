"""Queries for framing, detection, envelopes and stamping (FMT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from . import ingest
from .catalog import register
from .oracle_fixtures import with_fixtures


@register("fmt_ingest_summary", with_fixtures("""
SELECT tenant_id, dataset_id, count(*) AS lines,
  count(*) FILTER (WHERE wrapped) AS wrapped_lines,
  count(*) FILTER (WHERE is_stamped) AS stamped_lines,
  CAST(sum(strlen(line)) AS BIGINT) AS bytes_in
FROM stamped GROUP BY tenant_id, dataset_id"""))
def ingest_summary(spark, sf):
    """Minimum slice: split, detect, wrap, stamp, then per-dataset totals."""
    return ingest.dataset_line_summary(ingest.land_lines(fx.messages(spark, sf)))


from ..functions import text as T  # noqa: E402
from ..operators import framing  # noqa: E402

_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


@register("fmt01_split_lines", with_fixtures("""
SELECT seq, line_no, line FROM lines"""))
def q_split_lines(spark, sf):
    """FMT-01: every non-blank line with its position."""
    return framing.split_lines(fx.messages(spark, sf)).select("seq", "line_no", "line")


@register("fmt01_doc_lines", with_fixtures(f"""
SELECT seq, count(*) AS lines, CAST(sum(strlen(t.line)) AS BIGINT) AS bytes, CAST(max(t.pos - 1) AS BIGINT) AS last_line_no
FROM doc_messages m, unnest(string_split(m.data, chr(10))) WITH ORDINALITY AS t(line, pos)
WHERE NOT regexp_full_match(t.line, '{_WS}*')
GROUP BY seq"""))
def q_doc_lines(spark, sf):
    """FMT-01 on whole documents (multi-line prose, Unicode whitespace)."""
    lines = framing.split_lines(fx.doc_messages(spark, sf))
    return lines.groupBy("seq").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("line")).cast("long").alias("bytes"),
        F.max("line_no").cast("long").alias("last_line_no"),
    )


@register("fmt02_trim_payload", """
SELECT doc_id AS seq, CAST(strlen(trim(text, chr(0))) AS BIGINT) AS trimmed_bytes
FROM documents WHERE strlen(trim(text, chr(0))) > 0""")
def q_trim_payload(spark, sf):
    """FMT-02: NUL trim and empty drop over document payloads."""
    d = framing.trim_payload(fx.doc_messages(spark, sf))
    return d.select("seq", F.octet_length("data").cast("long").alias("trimmed_bytes"))


@register("fmt03_mode_dispatch", with_fixtures("""
SELECT seq, line_no, data_format, wrapped FROM landed"""))
def q_mode_dispatch(spark, sf):
    """FMT-03 + FMT-06: per line, was it wrapped (explicit or sticky auto)?"""
    lines = framing.detect_and_wrap(framing.split_lines(fx.messages(spark, sf)))
    return lines.select("seq", "line_no", "data_format", "wrapped")


@register("fmt04_json_valid", with_fixtures("""
SELECT seq, line_no, json_valid(line) AS valid FROM lines"""))
def q_json_valid(spark, sf):
    """FMT-04: strict whole-line JSON validity."""
    lines = framing.split_lines(fx.messages(spark, sf))
    return lines.select("seq", "line_no", T.is_valid_json("line").alias("valid"))


@register("fmt05_wrap_text", with_fixtures(r"""
SELECT seq, line_no, line AS raw,
  regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z' AS timestamp
FROM lines"""))
def q_wrap_text(spark, sf):
    """FMT-05: the text envelope, checked field by field."""
    lines = framing.split_lines(fx.messages(spark, sf))
    w = lines.select("seq", "line_no", T.wrap_text("line", "ts").alias("env"))
    return w.select(
        "seq", "line_no",
        F.get_json_object("env", "$.raw").alias("raw"),
        F.get_json_object("env", "$.timestamp").alias("timestamp"),
    )


@register("fmt06_sticky_detect", with_fixtures("""
SELECT input, tenant_id, dataset_id, CASE WHEN detected_json THEN 'ndjson' ELSE 'text' END AS format
FROM detect"""))
def q_sticky_detect(spark, sf):
    """FMT-06/07: the detection memo (first auto-mode line per key)."""
    return framing.detection_table(framing.split_lines(fx.messages(spark, sf)))


@register("fmt07_detect_cache_size", with_fixtures("""
SELECT count(*) AS cache_size, count(*) FILTER (WHERE detected_json) AS ndjson_keys FROM detect"""))
def q_detect_cache_size(spark, sf):
    """FMT-07: cache size = number of memoised keys."""
    d = framing.detection_table(framing.split_lines(fx.messages(spark, sf)))
    return d.agg(F.count(F.lit(1)).alias("cache_size"), F.count_if(F.col("format") == "ndjson").alias("ndjson_keys"))


@register("fmt08_ndjson_normalise", with_fixtures("""
SELECT seq, line_no, json_valid(trim(line)) AS ok,
  CASE WHEN json_valid(trim(line)) AND json_type(trim(line)) = 'OBJECT'
       THEN CAST(json_extract(trim(line), '$.k') AS VARCHAR) END AS k
FROM lines"""))
def q_ndjson_normalise(spark, sf):
    """FMT-08: compact re-serialisation; NULL marks the error case."""
    lines = framing.split_lines(fx.messages(spark, sf))
    out = lines.select("seq", "line_no", T.ndjson_normalise("line").alias("norm"))
    return out.select("seq", "line_no", F.col("norm").isNotNull().alias("ok"),
                      F.get_json_object("norm", "$.k").alias("k"))


@register("fmt10_generic_collapse", f"""
SELECT doc_id AS seq, md5(c) AS digest, CAST(strlen(c) AS BIGINT) AS bytes FROM (
  SELECT doc_id, regexp_replace(regexp_replace(
           regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '[\\n\\r]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS c
  FROM documents) WHERE c <> ''""")
def q_generic_collapse(spark, sf):
    """FMT-10: whole documents collapsed to one line."""
    d = fx.doc_messages(spark, sf).select("seq", T.collapse_one_line("data").alias("c")).where(F.col("c").isNotNull())
    return d.select("seq", F.md5("c").alias("digest"), F.octet_length("c").cast("long").alias("bytes"))


@register("fmt11_format_by_hint", with_fixtures("""
SELECT seq, line_no, data_hint,
  CASE WHEN data_hint = 'ndjson' THEN json_valid(trim(line)) ELSE true END AS ok,
  CASE WHEN data_hint = 'ndjson' THEN NULL ELSE md5(regexp_replace(line, ' {2,}', ' ', 'g')) END AS digest
FROM lines"""))
def q_format_by_hint(spark, sf):
    """FMT-11: formatter dispatch by hint (ndjson / raw / generic)."""
    lines = framing.split_lines(fx.messages(spark, sf))
    out = lines.select("seq", "line_no", "data_hint", framing.format_by_hint("line", "data_hint").alias("f"))
    return out.select(
        "seq", "line_no", "data_hint", F.col("f").isNotNull().alias("ok"),
        F.when(F.col("data_hint") == "ndjson", F.lit(None).cast("string")).otherwise(F.md5("f")).alias("digest"),
    )


@register("fmt12_compact_fast", with_fixtures(r"""
SELECT event_id, regexp_replace(data, '(?s)("(?:\\.|[^"\\])*(?:"|\\?\z))|[ \t\r\n]+', '\1', 'g') AS compact
FROM telemetry""", "telemetry"))
def q_compact_fast(spark, sf):
    """FMT-12: whitespace strip outside strings, no parse."""
    t = fx.telemetry(spark, sf)
    return t.select("event_id", T.compact_json_fast("data").alias("compact"))


@register("fmt13_telemetry_accept", with_fixtures(r"""
SELECT event_id, out, out IS NOT NULL AS accepted FROM (
  SELECT event_id,
    CASE WHEN p = '' THEN NULL
      WHEN NOT contains(p, chr(10)) AND ((starts_with(p, '{') AND suffix(p, '}')) OR p = 'null') THEN p
      WHEN NOT contains(p, chr(10)) THEN CASE WHEN json_valid(p) THEN CASE WHEN json_type(p) = 'OBJECT' THEN CAST(json(p) AS VARCHAR) END END
      ELSE regexp_replace(p, '(?s)("(?:\\.|[^"\\])*(?:"|\\?\z))|[ \t\r\n]+', '\1', 'g') END AS out
  FROM (SELECT event_id, trim(replace(data, chr(0), '')) AS p FROM telemetry))""", "telemetry"))
def q_telemetry_accept(spark, sf):
    """FMT-13: telemetry accept / compact / drop."""
    return framing.telemetry_accept(fx.telemetry(spark, sf)).select("event_id", "out", "accepted")


@register("fmt14_stamp", with_fixtures("""
SELECT seq, line_no,
  CASE WHEN data_hint IN ('ndjson', 'json') AND obj THEN epoch_us(ts) // 1000 END AS ingest_ms,
  CASE WHEN obj THEN CAST(json_extract(tl, '$.k') AS VARCHAR) END AS k,
  CASE WHEN obj AND data_hint NOT IN ('ndjson', 'json')
       THEN CAST(json_exists(tl, '$.Ingest_Ms') AS INT) + CAST(json_exists(tl, '$.INGEST_MS') AS INT) ELSE 0 END AS variants_left
FROM (SELECT *, trim(line) AS tl,
        CASE WHEN json_valid(trim(line)) THEN json_type(trim(line)) = 'OBJECT' ELSE false END AS obj
      FROM lines)"""))
def q_stamp(spark, sf):
    """FMT-14: ingest stamp on ndjson/json objects; others untouched."""
    lines = framing.split_lines(fx.messages(spark, sf))
    s = framing.stamp(lines, line="line", hint="data_hint", ts="ts")
    is_obj = F.try_variant_get(F.try_parse_json("stamped"), "$", "map<string,variant>")
    return s.select(
        "seq", "line_no",
        F.get_json_object("stamped", "$.ingest_ms").cast("long").alias("ingest_ms"),
        F.get_json_object("stamped", "$.k").alias("k"),
        F.when(T.is_valid_json("stamped") & is_obj.isNotNull(),
               F.size(F.filter(F.map_keys(is_obj), lambda k: F.lower(k) == "ingest_ms") )
               - F.when(F.col("data_hint").isin("ndjson", "json"), 1).otherwise(0))
        .otherwise(0).cast("int").alias("variants_left"),
    )


@register("fmt15_newline_rule", with_fixtures("""
SELECT seq, data_hint IN ('ndjson','csv','tsv','syslog','apache','nginx','iis','squid')
    AND strlen(data) > 0 AND NOT suffix(data, chr(10)) AS needs_newline
FROM messages"""))
def q_newline_rule(spark, sf):
    """FMT-15: which payloads get a newline appended when combined."""
    m = fx.messages(spark, sf)
    return m.select("seq", T.needs_newline("data", "data_hint").alias("needs_newline"))


@register("fmt16_line_count", f"""
SELECT doc_id AS seq, CAST(count(*) FILTER (WHERE NOT regexp_full_match(t.line, '{_WS}*')) AS INT) AS line_count
FROM documents d, unnest(string_split(d.text, chr(10))) AS t(line)
GROUP BY doc_id""")
def q_line_count(spark, sf):
    """FMT-16: non-blank line count per document payload."""
    d = fx.doc_messages(spark, sf)
    return d.select("seq", T.non_blank_line_count("data").alias("line_count"))


@register("fmt07_detect_with_reset", with_fixtures("""
SELECT input, tenant_id, dataset_id, epoch, CASE WHEN json_valid(line) THEN 'ndjson' ELSE 'text' END AS format
FROM (SELECT *, seq // 2500 AS epoch FROM lines WHERE data_format NOT IN ('ndjson', 'text'))
QUALIFY row_number() OVER (PARTITION BY input, tenant_id, dataset_id, epoch ORDER BY seq, line_no) = 1"""))
def q_detect_with_reset(spark, sf):
    """FMT-07: the memo cleared every 2500 messages (epoch in the key)."""
    lines = framing.split_lines(fx.messages(spark, sf)).withColumn("epoch", (F.col("seq") / 2500).cast("long"))
    return framing.detection_table(lines, epoch="epoch")


# A JSON object as its sorted "key=value" pairs, as both engines can say it.
_PAIRS_SQL = """list_sort(list_transform(json_keys({0}), lambda k: k || '=' || json_extract({0}, '$."' || k || '"')))"""


def _pairs(text: str):
    obj = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.array_join(F.array_sort(F.transform(F.map_entries(obj), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"])))), ",")


@register("fmt14_stamp_documents", with_fixtures(f"""
SELECT seq, line_no, CASE WHEN NOT obj THEN line
  WHEN data_hint NOT IN ('ndjson', 'json') THEN array_to_string({_PAIRS_SQL.format('tl')}, ',')
  ELSE array_to_string(list_sort(list_append(list_filter(list_transform(json_keys(tl),
         lambda k: CASE WHEN lower(k) <> 'ingest_ms' THEN k || '=' || json_extract(tl, '$."' || k || '"') END), lambda x: x IS NOT NULL),
         'ingest_ms=' || (epoch_us(ts) // 1000))), ',') END AS document
FROM (SELECT *, trim(line) AS tl,
        CASE WHEN json_valid(trim(line)) THEN json_type(trim(line)) = 'OBJECT' ELSE false END AS obj
      FROM lines)"""))
def q_stamp_documents(spark, sf):
    """FMT-14: every key and value of the stamped documents; lines that are
    no object stay as they are."""
    s = framing.stamp(framing.split_lines(fx.messages(spark, sf)), line="line", hint="data_hint", ts="ts")
    pairs = _pairs("stamped")
    return s.select("seq", "line_no", F.coalesce(F.when(T.is_valid_json("stamped"), pairs), F.col("stamped")).alias("document"))


@register("fmt08_ndjson_documents", with_fixtures(f"""
SELECT seq, line_no, CASE WHEN json_valid(trim(line)) THEN array_to_string({_PAIRS_SQL.format('trim(line)')}, ',') END AS document,
  json_valid(trim(line)) AS ok FROM lines"""))
def q_ndjson_documents(spark, sf):
    """FMT-08: every key and value of the normalised documents."""
    out = framing.split_lines(fx.messages(spark, sf)).withColumn("norm", T.ndjson_normalise("line"))
    return out.select("seq", "line_no", _pairs("norm").alias("document"), F.col("norm").isNotNull().alias("ok"))
