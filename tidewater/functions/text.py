"""Column functions for framing, JSON detection and text normalisation.

All are built from Spark's native expressions (regex, variant parsing,
string functions), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of a Unicode-aware trim (ASCII controls
# \t \n \v \f \r, NEL U+0085 and every separator of Unicode category Z).
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
_BLANK = r"\A" + WS + r"*\z"
_TRIM = r"\A" + WS + r"+|" + WS + r"+\z"

# Hints whose records are newline-terminated lines when
# files are combined.
LINE_BASED_HINTS = ("ndjson", "csv", "tsv", "syslog", "apache", "nginx", "iis", "squid")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(s) -> Column:
    """True when the string is empty or only Unicode whitespace."""
    return _c(s).rlike(_BLANK)


def unicode_trim(s) -> Column:
    """Trim Unicode whitespace from both ends (Spark's ``trim`` is space-only)."""
    return F.regexp_replace(_c(s), _TRIM, "")


def trim_nul(s) -> Column:
    """Strip NUL bytes from both ends (FMT-02)."""
    return F.btrim(_c(s), F.lit("\x00"))


def is_valid_json(s) -> Column:
    """Strict validity of a whole string as one JSON value (FMT-04).

    ``try_parse_json`` accepts a valid prefix followed by garbage, so the
    value is parsed twice, wrapped as an array element and as an object
    member: only a single complete JSON value survives both wraps.
    """
    c = _c(s)
    as_elem = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}")))
    return (~is_blank(c)) & as_elem.isNotNull() & as_member.isNotNull()


def rfc3339_nano(ts) -> Column:
    """UTC timestamp as RFC3339 with nanosecond precision, zeros trimmed."""
    full = F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(full, r"\.?0+\z", ""), F.lit("Z"))


def rfc3339(ts) -> Column:
    """UTC timestamp as RFC3339 with whole seconds."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def wrap_text(line, ts) -> Column:
    """Text envelope ``{"timestamp": <RFC3339Nano>, "raw": <line>}`` (FMT-05)."""
    return F.to_json(F.struct(rfc3339_nano(ts).alias("timestamp"), _c(line).alias("raw")))


# JSON whitespace outside string tokens. A string token runs to its closing
# quote, or to the end of input when unterminated (then kept verbatim).
_COMPACT = r'(?s)("(?:\\.|[^"\\])*(?:"|\\?\z))|[ \t\r\n]+'


def compact_json_fast(s) -> Column:
    """Remove whitespace outside JSON strings without parsing (FMT-12)."""
    return F.regexp_replace(_c(s), _COMPACT, "$1")


def collapse_one_line(s) -> Column:
    """Generic one-line form (FMT-10): trim, CR/LF to space, squeeze spaces.

    Empty results are NULL (the formatter's error case).
    """
    t = unicode_trim(_c(s))
    t = F.regexp_replace(F.regexp_replace(t, r"[\n\r]", " "), " {2,}", " ")
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def ndjson_normalise(s) -> Column:
    """Compact re-serialisation of one JSON line (FMT-08); NULL on error."""
    t = unicode_trim(_c(s))
    return F.when(is_valid_json(t), F.to_json(F.try_parse_json(t)))


def non_blank_line_count(s) -> Column:
    """Number of non-blank ``\\n``-separated lines (FMT-16)."""
    return F.size(F.filter(F.split(_c(s), "\n", -1), lambda l: ~l.rlike(_BLANK)))


def needs_newline(data, hint) -> Column:
    """True when combining must append ``\\n`` after this payload (FMT-15)."""
    d = _c(data)
    return (
        _c(hint).isin(*LINE_BASED_HINTS)
        & (F.length(d) > 0)
        & ~d.endswith("\n")
    )


def is_gzip(content) -> Column:
    """Gzip magic bytes at the start of a binary payload (FMT-17)."""
    return F.substring(_c(content), 1, 2) == F.unhex(F.lit("1F8B"))
