"""Naming and classification scalar functions (file names, hints, codes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hint_to_extension(hint) -> Column:
    """Data hint -> raw-file extension (PRJ-01)."""
    h = _c(hint)
    return (
        F.when(h.isin("ndjson", "json"), F.lit("ndjson"))
        .when(h.isin("syslog", "apache", "nginx", "iis", "squid"), F.lit("log"))
        .when(h.isin("csv", "tsv", "raw"), h)
        .when((h != "") & (F.octet_length(h) <= 10), h)
        .otherwise(F.lit("raw"))
    )


def filename_to_hint(name) -> Column:
    """Raw-file name -> data hint from its extension (PRJ-02)."""
    n = _c(name)
    ext = F.substring_index(n, ".", -1)
    no_ext = ~n.contains(".") | n.endswith(".")
    return (
        F.when(no_ext, F.lit("txt"))
        .when(ext == "log", F.lit("syslog"))
        .when(ext == "txt", F.lit("raw"))
        .otherwise(ext)
    )


def batch_filename(tenant, dataset, nanos, hint) -> Column:
    """Batch file name ``tenant--dataset--nanos--hint.gz`` (PRJ-03)."""
    return F.format_string("%s--%s--%d--%s.gz", _c(tenant), _c(dataset), _c(nanos).cast("long"), _c(hint))


def batch_id(tenant, dataset, nanos, hint) -> Column:
    """Batch id: the file name without ``.gz`` (PRJ-03)."""
    return F.format_string("%s--%s--%d--%s", _c(tenant), _c(dataset), _c(nanos).cast("long"), _c(hint))


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def batch_filename_to_hint(name) -> Column:
    """Batch file name -> hint (PRJ-04): 4th ``--`` part, else last ``.`` part."""
    b = F.regexp_replace(basename(name), r"\.gz\z", "")
    parts = F.split(b, "--", -1)
    dot_parts = F.split(b, r"\.", -1)
    return (
        F.when(F.size(parts) >= 4, parts.getItem(3))
        .when(b.contains("."), F.element_at(dot_parts, -1))
        .otherwise(F.lit(""))
    )


def filename_line_count(name) -> Column:
    """Expected line count from ``{nanos}_{bytes}_{lines}.{ext}`` (PRJ-05), else 0."""
    n = _c(name)
    rev_pos = F.locate(".", F.reverse(n))
    last_dot = F.length(n) - rev_pos + 1
    stem = F.when((rev_pos > 0) & (last_dot > 1), F.substring(n, F.lit(1), last_dot - 1)).otherwise(n)
    parts = F.split(stem, "_", -1)
    # Go's Atoi accepts an optional sign and ASCII digits only.
    third = parts.getItem(2)
    ok = (F.size(parts) == 3) & third.rlike(r"\A[+-]?[0-9]+\z")
    return F.when(ok, F.coalesce(third.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def line_count_mismatch(expected, actual) -> Column:
    """Verification rule (PRJ-06): expected > 0 and differs from actual."""
    return (_c(expected) > 0) & (_c(expected) != _c(actual))


# HTTP status codes always treated as permanent failures.
PERMANENT_CODES = (400, 401, 403, 404, 410, 413, 422)


def delivery_outcome(status_code) -> Column:
    """Classify an HTTP status (PRJ-07): success / permanent / transient.

    NULL status means a network error, which is transient.
    """
    s = _c(status_code)
    return (
        F.when(s.isNull(), F.lit("transient"))
        .when((s >= 200) & (s < 300), F.lit("success"))
        .when(s.isin(*PERMANENT_CODES), F.lit("permanent"))
        .when(s == 429, F.lit("transient"))
        .when((s >= 400) & (s < 500), F.lit("permanent"))
        .otherwise(F.lit("transient"))
    )


def mask_short(secret) -> Column:
    """Mask rule A (PRJ-08): up to 4 chars -> ``****``, else 2 + ``****`` + 2."""
    s = _c(secret)
    n = F.char_length(s)
    return (
        F.when(n == 0, s)
        .when(n <= 4, F.lit("****"))
        .otherwise(F.concat(F.substring(s, 1, 2), F.lit("****"), F.substring(s, -2, 2)))
    )


def mask_long(secret) -> Column:
    """Mask rule B (PRJ-08): up to 8 chars -> ``***``, else 4 + ``***`` + 4."""
    s = _c(secret)
    n = F.char_length(s)
    return (
        F.when(n == 0, s)
        .when(n <= 8, F.lit("***"))
        .otherwise(F.concat(F.substring(s, 1, 4), F.lit("***"), F.substring(s, -4, 4)))
    )


def human_bytes(n) -> Column:
    """``nMB`` / ``nKB`` / ``n bytes`` with integer division (PRJ-11)."""
    b = _c(n).cast("long")
    mb, kb = 1024 * 1024, 1024
    return (
        F.when(b >= mb, F.concat((b / F.lit(mb)).cast("long").cast("string"), F.lit("MB")))
        .when(b >= kb, F.concat((b / F.lit(kb)).cast("long").cast("string"), F.lit("KB")))
        .otherwise(F.concat(b.cast("string"), F.lit(" bytes")))
    )


# Configuration keys whose values are never shown.
MASKED_KEYS = ("bearer_token", "password", "secret", "token")


def mask_config(config) -> Column:
    """Replace sensitive values of a config map with ``***MASKED***`` (PRJ-12)."""
    return F.transform_values(
        _c(config), lambda k, v: F.when(k.isin(*MASKED_KEYS), F.lit("***MASKED***")).otherwise(v)
    )


def to_int(value) -> Column:
    """Numeric coercion of a variant (PRJ-09): integers as-is, floating
    values truncated toward zero, anything else not ok.

    Returns a struct ``(value long, ok boolean)``. (Integers beyond 2^53 keep
    their digits: the variant holds them exactly.)
    """
    v = _c(value)
    t = F.schema_of_variant(v)
    integral = t.rlike(r"\A(TINYINT|SMALLINT|INT|BIGINT)\z")
    fractional = t.rlike(r"\A(FLOAT|DOUBLE|DECIMAL)")
    iv = F.when(integral, F.try_variant_get(v, "$", "bigint")).when(
        fractional, F.try_variant_get(v, "$", "double").try_cast("long"))
    ok = F.coalesce(integral | fractional, F.lit(False)) & iv.isNotNull()
    return F.struct(F.when(ok, iv).alias("value"), ok.alias("ok"))


def with_ip_text(df: DataFrame, src: str, out: str) -> DataFrame:
    """PRJ-10: 4-byte IPv4 / 16-byte IPv6 address text; other lengths as
    base64. IPv4-mapped IPv6 prints as dotted IPv4; otherwise groups are
    lower-case hex without leading zeros and the longest run of two or more
    zero groups (the first on ties) becomes ``::``. No UDF.

    Intermediate values (hex, group string, the longest run and its place) are
    separate projections, so each is computed once per row and the
    generated code stays small when several addresses are rendered in one
    operator.
    """
    t = f"_ip_{out}"
    x = F.col(src)
    d = df.withColumn(f"{t}_h", F.hex(x))
    hx = F.col(f"{t}_h")
    groups = [F.ltrim(F.substring(hx, 4 * i + 1, 4), F.lit("0")) for i in range(8)]
    six = F.lower(F.concat_ws(":", *[F.when(g == "", F.lit("0")).otherwise(g) for g in groups]))
    d = d.withColumn(f"{t}_g", F.when(F.length(hx) == 32, six))
    d = d.withColumn(f"{t}_f", F.concat(F.lit(":"), F.col(f"{t}_g"), F.lit(":")))
    framed, run, pos = F.col(f"{t}_f"), F.col(f"{t}_r"), F.col(f"{t}_p")
    longest = F.coalesce(*[F.when(framed.contains(":" + "0:" * ln), F.lit(ln)) for ln in range(8, 1, -1)], F.lit(0))
    d = d.withColumn(f"{t}_r", F.when(framed.isNotNull(), longest))
    d = d.withColumn(f"{t}_p", F.instr(framed, F.concat(F.lit(":"), F.repeat(F.lit("0:"), run))))
    right = F.substring(framed, pos + run * 2 + 1, F.lit(64))
    squeezed = F.concat(F.substring(framed, F.lit(2), pos - 2), F.lit("::"), F.substring(right, F.lit(1), F.length(right) - 1))
    v6 = F.when(run > 0, squeezed).otherwise(F.col(f"{t}_g"))
    n = F.length(hx) / 2

    def dotted(at: int) -> Column:
        number = F.conv(F.substring(hx, at, 8), 16, 10).cast("long")
        return F.concat_ws(".", *[F.shiftright(number, bits).bitwiseAND(255).cast("string") for bits in (24, 16, 8, 0)])

    mapped = F.substring(hx, 1, 24) == F.lit("00000000000000000000FFFF")
    text = (F.when(n == 4, dotted(1))
            .when((n == 16) & mapped, dotted(25))
            .when(n == 16, v6).otherwise(F.base64(x)))
    return d.withColumn(out, text).drop(f"{t}_h", f"{t}_g", f"{t}_f", f"{t}_r", f"{t}_p")
