"""Identifier validation (tenant / dataset ids) as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier pattern, maximum length in bytes, and the
# reserved names (compared case-insensitively).
ID_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9_-]*[a-zA-Z0-9]$|^[a-zA-Z0-9]$"
MAX_ID_BYTES = 64
RESERVED_NAMES = (
    "tmp", "temp", "cache", "log", "logs", "var", "etc", "bin", "usr", "opt",
    "udp", "tcp", "http", "https", "ftp", "ssh", "syslog",
    "api", "admin", "root", "system",
    "meta", "metadata", "config", "settings", "status", "health",
    "con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_reserved(name, application: Sequence[str] = ()) -> Column:
    """VAL-02: reserved name, case-insensitive; ``application`` adds the names
    that an application keeps for itself."""
    return F.lower(_c(name)).isin(*RESERVED_NAMES, *[w.lower() for w in application])


def identifier_error(value, application: Sequence[str] = ()) -> Column:
    """VAL-01: NULL when valid, else the error code
    (``empty`` / ``too_long`` / ``pattern`` / ``reserved``)."""
    v = _c(value)
    return (
        F.when(v.isNull() | (v == ""), F.lit("empty"))
        .when(F.octet_length(v) > MAX_ID_BYTES, F.lit("too_long"))
        .when(~v.rlike(ID_PATTERN), F.lit("pattern"))
        .when(is_reserved(v, application), F.lit("reserved"))
    )


def pair_error(tenant, dataset) -> Column:
    """VAL-03: first error of the pair check (tenant, dataset, then
    equality ignoring case), NULL when valid."""
    t, d = _c(tenant), _c(dataset)
    te, de = identifier_error(t), identifier_error(d)
    return (
        F.when(te.isNotNull(), F.concat(F.lit("tenant:"), te))
        .when(de.isNotNull(), F.concat(F.lit("dataset:"), de))
        .when(F.lower(t) == F.lower(d), F.lit("same"))
    )


# Fixed value: name patterns never served (path traversal).
UNSAFE_FILENAME = r"\.\.|/|\\"


def is_safe_filename(name) -> Column:
    """VAL-08: no ``..``, ``/`` or ``\\`` in the name."""
    return ~_c(name).rlike(UNSAFE_FILENAME)
