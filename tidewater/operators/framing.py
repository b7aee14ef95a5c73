"""Framing, format detection, envelopes and ingest stamping.

Rows in: messages ``(… keys …, data, …)``; rows out: one row per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The stamp key and the hints whose lines are stamped.
DETECT_KEYS = ("input", "tenant_id", "dataset_id")
ORDER = ("seq", "line_no")
STAMP_KEY = "ingest_ms"
STAMPED_HINTS = ("ndjson", "json")


def split_lines(df: DataFrame, data: str = "data", keep_blank: bool = False) -> DataFrame:
    """FMT-01: one row per ``\\n``-separated line, whitespace-only lines dropped.

    Adds ``line_no`` (0-based position in the message) and ``line``; the
    payload column is replaced, so wide payloads are not carried twice.
    """
    cols = [c for c in df.columns if c != data]
    out = df.select(*cols, F.posexplode(F.split(F.col(data), "\n", -1)).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("long"))
    return out if keep_blank else out.where(~T.is_blank("line"))


def trim_payload(df: DataFrame, data: str = "data") -> DataFrame:
    """FMT-02: strip NULs at both ends and drop payloads left empty."""
    return df.withColumn(data, T.trim_nul(data)).where(F.length(data) > 0)


def is_auto_mode(mode: Column) -> Column:
    """Everything but explicit ``ndjson`` / ``text`` is auto-detect (FMT-03)."""
    return ~F.coalesce(mode, F.lit("")).isin("ndjson", "text")


def first_line_detection(
    lines: DataFrame,
    keys: Sequence[str] = DETECT_KEYS,
    order: Sequence[str] = ORDER,
    mode: str = "data_format",
) -> DataFrame:
    """FMT-06 memo: per key, is the *first* auto-mode line valid JSON?

    One aggregate: each task keeps one line per key, whatever the skew.
    """
    auto = lines.where(is_auto_mode(F.col(mode))) if mode in lines.columns else lines
    first = auto.groupBy(*keys).agg(F.min_by("line", F.struct(*order)).alias("first_line"))
    return first.select(*keys, T.is_valid_json("first_line").alias("detected_json"))


def message_detection(
    messages: DataFrame,
    keys: Sequence[str] = DETECT_KEYS,
    order: str = ORDER[0],
    mode: str = "data_format",
    data: str = "data",
) -> DataFrame:
    """FMT-06 memo from whole messages: the first non-blank line of each
    message competes, so no line is exploded for the decision."""
    lines = F.filter(F.split(F.col(data), "\n", -1), lambda l: ~T.is_blank(l))
    auto = messages.where(is_auto_mode(F.col(mode))) if mode in messages.columns else messages
    heads = auto.select(*keys, order, F.try_element_at(lines, F.lit(1)).alias("line")).where(F.col("line").isNotNull())
    first = heads.groupBy(*keys).agg(F.min_by("line", F.struct(order, "line")).alias("first_line"))
    return first.select(*keys, T.is_valid_json("first_line").alias("detected_json"))


def with_detection(lines: DataFrame, detection: DataFrame, keys: Sequence[str] = DETECT_KEYS) -> DataFrame:
    """Attach ``detected_json`` by key; NULL keys meet NULL keys."""
    d = detection.select(*[F.col(k).alias(f"_d_{k}") for k in keys], "detected_json")
    on = F.lit(True)
    for k in keys:
        on = on & lines[k].eqNullSafe(F.col(f"_d_{k}"))
    return lines.join(d, on, "left").drop(*[f"_d_{k}" for k in keys])


def detect_and_wrap(
    lines: DataFrame,
    keys: Sequence[str] = DETECT_KEYS,
    order: Sequence[str] = ORDER,
    mode: str = "data_format",
    ts: str = "ts",
    detection: DataFrame | None = None,
) -> DataFrame:
    """FMT-03 + FMT-05 + FMT-06: dispatch on mode, sticky auto-detect, wrap text.

    Adds ``wrapped`` (bool) and ``out`` (the line as it is landed).
    ``detection`` is the memo, made from the lines when not given.
    """
    det = detection if detection is not None else first_line_detection(lines, keys, order, mode)
    j = with_detection(lines, det, keys)
    m = F.coalesce(F.col(mode), F.lit(""))
    wrapped = F.when(m == "ndjson", F.lit(False)).when(m == "text", F.lit(True)).otherwise(~F.col("detected_json"))
    return (
        j.withColumn("wrapped", wrapped)
        .withColumn("out", F.when(F.col("wrapped"), T.wrap_text("line", ts)).otherwise(F.col("line")))
        .drop("detected_json")
    )


def detection_table(lines: DataFrame, keys: Sequence[str] = DETECT_KEYS, epoch: str | None = None,
                    order: Sequence[str] = ORDER, mode: str = "data_format") -> DataFrame:
    """FMT-07: the detection memo with an optional reset ``epoch`` in its key.

    Clearing one dataset's cache = bumping its epoch; clearing all = bumping
    every epoch. The cache size is ``count()`` of this table.
    """
    k = list(keys) + ([epoch] if epoch else [])
    return first_line_detection(lines, k, order, mode).select(
        *k, F.when(F.col("detected_json"), F.lit("ndjson")).otherwise(F.lit("text")).alias("format")
    )


def stamp(df: DataFrame, line: str = "out", hint: str = "data_hint", ts: str = "ts",
          key: str = STAMP_KEY, into: str = "stamped") -> DataFrame:
    """FMT-14: stamp lines of ``ndjson`` / ``json`` hints with ingest millis.

    Staged projections: only lines of a stamped hint that look like an
    object after trimming are parsed, and the parse (one array-wrapped
    variant, from which the object map is read) plus the strict-validity
    check are computed once per row.
    """
    l = F.col(line)
    cand = F.col(hint).isin(*STAMPED_HINTS)
    d = df.withColumn("_st_t", F.when(cand, T.unicode_trim(l)))
    t = F.col("_st_t")
    looks = t.startswith("{") & t.endswith("}")
    d = d.withColumn("_st_arr", F.when(looks, F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))))
    obj = F.try_variant_get(F.col("_st_arr"), "$[0]", "map<string,variant>")
    strict = F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}"))).isNotNull()
    d = d.withColumn("_st_obj", F.when(F.col("_st_arr").isNotNull() & strict, obj))
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    kept = F.map_filter(F.col("_st_obj"), lambda k, v: F.lower(k) != key.lower())
    stamped = F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(ms.cast("string")))))
    return d.withColumn(into, F.when(F.col("_st_obj").isNotNull(), stamped).otherwise(l)) \
        .drop("_st_t", "_st_arr", "_st_obj")


def format_by_hint(line, hint) -> Column:
    """FMT-11 dispatch (FMT-08/09/10): ndjson -> compact JSON, raw/empty ->
    as-is, anything else -> generic one-line. NULL marks a formatter error."""
    h = F.coalesce(F.col(hint) if isinstance(hint, str) else hint, F.lit(""))
    l = F.col(line) if isinstance(line, str) else line
    return (
        F.when(h == "ndjson", T.ndjson_normalise(l))
        .when(h.isin("raw", ""), l)
        .otherwise(T.collapse_one_line(l))
    )


def telemetry_accept(df: DataFrame, data: str = "data") -> DataFrame:
    """FMT-13: the telemetry accept rule.

    The payload is NUL- and whitespace-trimmed; empty payloads are dropped.
    Single-line ``{…}`` payloads pass untouched (no parse); other single-line
    payloads must parse as a JSON object (or be ``null``) and are
    re-serialised compactly, else they are dropped; multi-line payloads are compacted without parsing
    (FMT-12). Adds ``accepted`` and ``out``.
    """
    p = T.unicode_trim(T.trim_nul(F.col(data)))
    single = ~p.contains("\n")
    braced = p.startswith("{") & p.endswith("}")
    parsed = F.try_parse_json(p)
    is_obj = T.is_valid_json(p) & F.try_variant_get(parsed, "$", "map<string,variant>").isNotNull()
    out = (
        F.when(p == "", F.lit(None).cast("string"))
        .when(single & (braced | (p == "null")), p)
        .when(single & is_obj, F.to_json(parsed))
        .when(~single, T.compact_json_fast(p))
    )
    return df.withColumn("out", out).withColumn("accepted", F.col("out").isNotNull())
