"""Names, hints, classification and identifier validation."""

import base64
import ipaddress
import random

from pyspark.sql import functions as F

from tidewater.functions import ident
from tidewater.functions import naming as N


def _col(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_batch_filename_to_hint_table(spark):
    cases = {
        "acme--logs--1736938245123456789--raw.gz": "raw",
        "company--metrics--1736938245123456789--csv.gz": "csv",
        "tenant1--dataset1--1736938245123456789--ndjson.gz": "ndjson",
        "batch_123456789.raw.gz": "raw",
        "batch_987654321.csv.gz": "csv",
        "batch_123456789..gz": "",
        "batch_123456789.gz": "",
        "/path/to/file/acme--logs--123456789--ndjson.gz": "ndjson",
        "acme--logs--123456789--xml": "xml",
    }
    assert _col(spark, list(cases), N.batch_filename_to_hint) == list(cases.values())


def test_batch_filename_round_trip(spark):
    df = spark.createDataFrame([("acme", "logs", 1736938245123456789, "raw")], "t string, d string, n long, h string")
    name = df.select(N.batch_filename("t", "d", "n", "h")).first()[0]
    assert name == "acme--logs--1736938245123456789--raw.gz"


def test_hint_extension_round_trip(spark):
    hints = ["json", "ndjson", "nginx", "syslog", "csv", "tsv", "raw", "", "custom", "elevenbytes"]
    exts = _col(spark, hints, N.hint_to_extension)
    assert exts == ["ndjson", "ndjson", "log", "log", "csv", "tsv", "raw", "raw", "custom", "raw"]
    names = ["1_2_3." + e for e in exts] + ["noext", "a.txt"]
    assert _col(spark, names, N.filename_to_hint) == [
        "ndjson", "ndjson", "syslog", "syslog", "csv", "tsv", "raw", "raw", "custom", "raw", "txt", "raw"]


def test_filename_line_count(spark):
    vals = ["1_2_3.ndjson", "1_2_x.log", "1_2.log", "1_2_3_4.csv", "1_2_-7", ".hidden"]
    assert _col(spark, vals, N.filename_line_count) == [3, 0, 0, 0, -7, 0]


def test_delivery_outcome(spark):
    codes = [200, 204, 400, 401, 403, 404, 410, 413, 422, 418, 429, 500, 503, 302, None]
    exp = ["success", "success"] + ["permanent"] * 8 + ["transient"] * 5
    assert _col(spark, codes, N.delivery_outcome, "v int") == exp


def test_masking(spark):
    vals = ["", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi"]
    assert _col(spark, vals, N.mask_short) == ["", "****", "****", "ab****de", "ab****gh", "ab****hi"]
    assert _col(spark, vals, N.mask_long) == ["", "***", "***", "***", "***", "abcd***fghi"]


def test_human_bytes(spark):
    assert _col(spark, [0, 1023, 1024, 5 * 1048576 + 7], N.human_bytes, "v long") == ["0 bytes", "1023 bytes", "1KB", "5MB"]


def test_to_int(spark):
    df = spark.createDataFrame([("3",), ("-2.9",), ('"x"',), ("12345678901234",), ("true",)], "v string")
    out = [tuple(r[0]) for r in df.select(N.to_int(F.parse_json("v"))).collect()]
    assert out == [(3, True), (-2, True), (None, False), (12345678901234, True), (None, False)]


def test_ip_text_matches_reference_formatting(spark):
    random.seed(7)
    vals = []
    for _ in range(500):
        k = random.randint(0, 4)
        if k == 0:
            b = bytes(random.randint(0, 255) for _ in range(4))
        elif k == 1:
            b = bytes(10) + b"\xff\xff" + bytes(random.randint(0, 255) for _ in range(4))
        elif k == 2:
            b = bytes(random.choice([0, 0, 1]) for _ in range(16))
        elif k == 3:
            b = bytes(random.randint(0, 255) for _ in range(random.choice([1, 5, 17])))
        else:
            b = bytes(16)
        vals.append(b)
    df = spark.createDataFrame([(bytearray(v),) for v in vals], "v binary")
    got = [r.t for r in N.with_ip_text(df, "v", "t").collect()]
    for b, g in zip(vals, got):
        if len(b) == 4:
            exp = str(ipaddress.IPv4Address(b))
        elif len(b) == 16:
            a = ipaddress.IPv6Address(b)
            exp = str(a.ipv4_mapped) if a.ipv4_mapped else a.compressed
        else:
            exp = base64.b64encode(b).decode()
        assert g == exp, (b.hex(), g, exp)


def test_identifiers(spark):
    valid = ["a", "1", "a1", "customer1", "app-logs", "data_set", "test-data_v2", "ABC123"]
    invalid = ["", "-test", "test-", "_test", "test_", "te st", "a.b", "a@b", "a/b", "a\\b", "a:b", "a?b", "a#b", "a%b",
               "x" * 65]
    assert _col(spark, valid, ident.identifier_error) == [None] * len(valid)
    assert all(e is not None for e in _col(spark, invalid, ident.identifier_error))
    reserved = ["admin", "ROOT", "System", "api", "tmp", "log", "var", "etc", "bin", "udp", "tcp", "http",
                "syslog", "con", "prn", "aux", "nul", "com1", "LPT1"]
    assert _col(spark, reserved, ident.identifier_error) == ["reserved"] * len(reserved)
    own = lambda c: ident.identifier_error(c, ("Gateway",))
    assert _col(spark, ["gateway", "GATEWAY", "gate"], own) == ["reserved", "reserved", None]
    df = spark.createDataFrame([("acme", "ACME"), ("acme", "events"), ("admin", "events")], "t string, d string")
    assert [r[0] for r in df.select(ident.pair_error("t", "d")).collect()] == ["same", None, "tenant:reserved"]


def test_unsafe_filenames(spark):
    assert _col(spark, ["ok.gz", "../x", "a/b", "a\\b"], ident.is_safe_filename) == [True, False, False, False]
