"""Secret scan: fixed patterns, and dictionary-primed compression novelty.

The base patterns are reported as they match. Beyond them, every long run of
key characters in a sensitive context is a candidate: its novelty is the
number of bytes that it adds to the zstandard frame of the text around it,
with a compressor primed with a dictionary of common identifiers. Words,
paths and names repeat what surrounds them or what the dictionary holds and
add few bytes; random keys add nearly their own length and are reported,
letter-only ones too. The context is sensitive if one of its words stands in
the candidate or shortly before it, on this line or an earlier one, or in the
header of the PEM block around it (one without an end line reaches to the next
header or the end of the text).

All work is one pass over the texts inside the scan tasks; nothing is
shuffled.

Defined results: a NULL text counts as empty; an empty table gives an empty
result; repeated rows are reported each; a NULL doc_id is carried along; of
spans that start together the kinds go in the order of ``KINDS``; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")

# The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Every access and hex match lies in a run of these characters.
RUN = r"[A-Za-z0-9+/_=.~-]{16,}"
SENSITIVE = r"passw|pwd|secret|token|key|auth|bearer|credential|private|session|signature|license|login|cookie"

# The lines that open and close a PEM block.
PEM = r"-----(BEGIN|END)([^\n-]{0,64})-----"

IDENTIFIERS = """
account action address admin alias append apply argument array assert async await backend base64 batch boolean
bucket buffer build bytes cache callback cancel catch channel class client close cluster code column commit compile
component config connect connection console const constant constructor container content context controller count
create current custom database default define delete deploy describe destroy device dictionary directory document
domain download driver element email enable encode endpoint engine entity enum environment error event exception
execute export expression false fetch field file filter final float folder format function generate global group
handler hash header height hidden host http https identifier image implement import include index initialize input
insert instance integer interface internal item join json label language length library limit list listener load
local location logger main manager message metadata method model module network node null number object offset
operator option order output package parameter parent parse password path pattern payload permission pipeline
platform policy port prefix private process profile project property protocol public publish python query queue
random record reference register remote replace request require reset resource response result return route scope
script search secret select sequence serialize server service session
""".split()


@dataclass(frozen=True)
class Novelty:
    """How much text around a candidate primes the compressor, how far before
    it a sensitive word may stand, and the least share of its
    own length that a reported string adds to the frame."""

    around: int = 1024
    reach: int = 48
    least: float = 0.6


class Scanner:
    def __init__(self, novelty: Novelty):
        import re

        import zstandard

        self.novelty = novelty
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex, self.run = re.compile(ACCESS), re.compile(HEX), re.compile(RUN)
        self.sensitive = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII)
        self.pem = re.compile(PEM)
        words = " ".join(IDENTIFIERS).encode()
        primer = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.frame = zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False, write_dict_id=False)

    def marginal(self, text: str, start: int, end: int) -> float:
        """Bytes that the candidate adds, over its own length."""
        around = self.novelty.around
        before, cand = text[max(0, start - around):start], text[start:end]
        side = (before + "\n" + text[end:end + around]).encode("utf-8", "replace")
        more = len(self.frame.compress(side + b"\n" + cand.encode())) - len(self.frame.compress(side + b"\n"))
        return more / max(1, end - start)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the bodies of PEM blocks with a sensitive header."""
        if "-----BEGIN" not in text:
            return []
        marks = [(m.start(), m.end(), m[1] == "BEGIN" and self.sensitive.search(m[2])) for m in self.pem.finditer(text)]
        stops = [start for start, _, _ in marks[1:]] + [len(text)]
        return [(end, stop) for (_, end, opens), stop in zip(marks, stops) if opens]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all spans of a text, in order."""
        out = []
        if ":" in text or "=" in text:
            out += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        runs = [m.span() for m in self.run.finditer(text)]
        for s, e in runs:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text, s, e) if m.end() - m.start() >= LEAST["access"]]
            out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text, s, e) if m.end() - m.start() >= LEAST["hex"]]
        base, blocks, at = sorted(out), self.blocks(text), 0
        for s, e in runs:
            if any(a < e and s < b for a, _, b in base):
                continue
            while at < len(blocks) and blocks[at][1] <= s:
                at += 1
            inside = at < len(blocks) and blocks[at][0] < e
            if (inside or self.sensitive.search(text, max(0, s - self.novelty.reach), e)) and self.marginal(text, s, e) >= self.novelty.least:
                out.append((s, 3, e))
        return sorted(out)


def find_secrets(docs: DataFrame, novelty: Novelty = Novelty()) -> DataFrame:
    """doc_id and the spans (kind, start, end) of every document; positions
    count code points, the end is exclusive."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        scan = Scanner(novelty)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for part in parts:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                found = []
                for raw in some.column("text").cast(pa.binary()).to_pylist():
                    spans = scan.spans(raw.decode("utf-8", "replace")) if raw else []
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(found, pa.list_(kind))],
                                                 names=["doc_id", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts a kind, the digest of the base spans, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    base = F.filter("spans", lambda s: s.kind != KINDS[3])
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        number(KINDS[3]).alias("n_novel"))
