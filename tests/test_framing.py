"""Framing, JSON validity, detection, envelope, stamp, compaction."""

import json

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import framing


def _one(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_json_validity_boundaries(spark):
    valid = ['123', '"a"', 'null', '[1,2]', ' {"a":1} ', '{"a":1,"a":2}']
    invalid = ['', '   ', '{"a":1} x', '{"a":1}{"b":2}', 'NaN', '{"a":1,}', '1],[2', '1,2']
    assert _one(spark, valid, T.is_valid_json) == [True] * len(valid)
    assert _one(spark, invalid, T.is_valid_json) == [False] * len(invalid)


def test_blank_is_unicode_aware(spark):
    vals = ["", " ", "\t  ", "\u0085", "a", " x "]
    assert _one(spark, vals, T.is_blank) == [True, True, True, True, False, False]


def test_split_lines_drops_blank_keeps_bytes(spark):
    df = spark.createDataFrame([(1, "a\n \t\n\r\n b \nc")], "seq long, data string")
    rows = framing.split_lines(df).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(0, "a"), (3, " b "), (4, "c")]


def _detect(spark, lines):
    df = spark.createDataFrame(
        [("in", "t", "d", "auto", i, l) for i, l in enumerate(lines)],
        "input string, tenant_id string, dataset_id string, data_format string, seq long, data string")
    df = df.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return [r.wrapped for r in framing.detect_and_wrap(framing.split_lines(df)).orderBy("seq").collect()]


def test_sticky_detection_first_line_decides(spark):
    assert _detect(spark, ['{"a":1}', "plain text", "[1]"]) == [False, False, False]
    assert _detect(spark, ["plain text", '{"a":1}']) == [True, True]
    # A blank first message carries no line; the next line decides.
    assert _detect(spark, ["  ", "text later"]) == [True]


def test_wrap_text_envelope(spark):
    df = spark.createDataFrame([('say "hi"\t\\', "2024-01-02 03:04:05.120000"), ("x", "2024-01-02 03:04:05")],
                               "line string, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = [json.loads(r[0]) for r in df.select(T.wrap_text("line", "ts")).collect()]
    assert out[0] == {"timestamp": "2024-01-02T03:04:05.12Z", "raw": 'say "hi"\t\\'}
    assert out[1] == {"timestamp": "2024-01-02T03:04:05Z", "raw": "x"}


def test_stamp_rules(spark):
    rows = [('{"ingest_ms":1,"INGEST_MS":2,"a":null}', "ndjson"), ("[1]", "ndjson"), ("null", "ndjson"), ("text", "json"),
            ("{}", "ndjson"), ('{"a":1}', "csv"), ('{"a":1} x', "ndjson")]
    df = spark.createDataFrame(rows, "line string, data_hint string").withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-01 00:00:00.123456")))
    out = [r.stamped for r in framing.stamp(df, line="line").collect()]
    ms = 1704067200123
    assert json.loads(out[0]) == {"a": None, "ingest_ms": ms}
    assert out[1:4] == ["[1]", "null", "text"]
    assert json.loads(out[4]) == {"ingest_ms": ms}
    assert out[5] == '{"a":1}'
    assert out[6] == '{"a":1} x'


def test_compact_json_fast(spark):
    vals = ['{ "a" : "x y" }', '{"a": "q\\" z"}', '{"a": "b\\\\" , "c": 1}', '{"a": "unterminated  x',
            'a \\ b', '{"a": "ends with \\']
    exp = ['{"a":"x y"}', '{"a":"q\\" z"}', '{"a":"b\\\\","c":1}', '{"a":"unterminated  x', 'a\\b', '{"a":"ends with \\']
    assert _one(spark, vals, T.compact_json_fast) == exp


def test_telemetry_accept(spark):
    df = spark.createDataFrame([("\x00 {\"a\": 1} \x00",), ("[1]",), ("text",), ('{\n "a" : 1\n}',), ("  ",)], "data string")
    rows = framing.telemetry_accept(df).collect()
    assert [(r.accepted, r.out) for r in rows] == [
        (True, '{"a": 1}'), (False, None), (False, None), (True, '{"a":1}'), (False, None)]


def test_generic_collapse_and_dispatch(spark):
    assert _one(spark, ["  a\r\nb   c  ", "   "], T.collapse_one_line) == ["a b c", None]
    df = spark.createDataFrame([(' {"b": 2, "a":1} ', "ndjson"), ("x  y", "raw"), ("x  y", ""), ("x \n y", "csv")],
                               "line string, hint string")
    out = [r[0] for r in df.select(framing.format_by_hint("line", "hint")).collect()]
    assert json.loads(out[0]) == {"a": 1, "b": 2} and out[1:] == ["x  y", "x  y", "x y"]


def test_line_count_and_newline_rule(spark):
    assert _one(spark, ["a\n\n b\n", "", "x"], T.non_blank_line_count) == [2, 0, 1]
    df = spark.createDataFrame([("a", "ndjson"), ("a\n", "csv"), ("a", "raw"), ("", "csv")], "d string, h string")
    assert [r[0] for r in df.select(T.needs_newline("d", "h")).collect()] == [True, False, False, False]


def test_gzip_magic(spark):
    import gzip
    df = spark.createDataFrame([(bytearray(gzip.compress(b"x")),), (bytearray(b"plain"),)], "b binary")
    assert [r[0] for r in df.select(T.is_gzip("b")).collect()] == [True, False]
