"""Tokenising inside tasks with the public tokenizer files.

The word tokenizer never merges across white space, so a text's ids are the
ids of its white-space-separated units one after the other. Each Python
worker keeps the ids of the units it has met in a bounded memo. ASCII letters
are lower-cased before the look-up: the tokenizer's own normaliser does so
too, and the memo gets fewer entries. A new unit of plain letters, digits and
signs is cut where the tokenizer's own splitter cuts, and its parts go
straight to the tokenizer's model; any other unit goes through the whole
tokenizer.
"""

from __future__ import annotations

MEMO_UNITS = 250_000
MEMO_PARTS = 180_000
# Longer units are not remembered.
MEMO_UNIT_BYTES = 64


def default_path() -> str:
    """The word tokenizer's file where the public files are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level tokenizer names each byte: visible
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None, plain: bool = False):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        # plain: the strings of special ids are ordinary text.
        self.tokenizer.encode_special_tokens = plain
        self.model_ids = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        # Strings that the tokenizer takes as single ids before it lower-cases.
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Visible ASCII without the apostrophe (contractions), Latin-1 letters.
        self.plain_text = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
        self.parts_of = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
        self.forget()

    def forget(self) -> None:
        learn = self._learn

        class Memo(dict):
            def __missing__(self, unit):
                ids = learn(unit)
                if len(unit) <= MEMO_UNIT_BYTES:
                    self[unit] = ids
                return ids

        self.memo, self.parts = Memo(), {}

    def _part(self, part: str) -> bytes:
        from array import array

        known = self.parts.get(part)
        if known is None:
            name = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            known = array("I", [t.id for t in self.model_ids(name)]).tobytes()
            if len(part) <= MEMO_UNIT_BYTES:
                self.parts[part] = known
        return known

    def _learn(self, unit: bytes) -> bytes:
        from array import array

        if unit.isalpha():
            return self._part(unit.decode())
        text = unit.decode("utf-8", "replace")
        if self.plain_text(text) and not (self.special and "<|" in text):
            return b"".join(map(self._part, self.parts_of(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a UTF-8 text; NULL counts as empty."""
        if not text:
            return b""
        if self.special and b"<|" in text:
            # Lower-casing must neither make nor break a special string.
            units = [u if b"<|" in u else u.lower() for u in text.split()]
        else:
            units = text.lower().split()
        return b"".join(map(self.memo.__getitem__, units))

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.memo) > MEMO_UNITS or len(self.parts) > MEMO_PARTS:
            self.forget()
        return list(map(self.encode, texts))


def worker_encoder(path: str | None, plain: bool = False) -> UnitEncoder:
    """This Python worker's encoder: its memo lives on from task to task."""
    import sys
    import types

    store = sys.modules.setdefault("_tidewater_worker", types.ModuleType("_tidewater_worker")).__dict__
    if ("encoder", path, plain) not in store:
        store["encoder", path, plain] = UnitEncoder(path, plain)
    return store["encoder", path, plain]


def batches(column, most_bytes: int = 4 << 20):
    """Slices of an Arrow string column as lists of UTF-8 texts, cut where
    their bytes reach ``most_bytes``; a longer text comes alone."""
    import pyarrow as pa

    texts = column.cast(pa.binary()).to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most_bytes:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
