"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

A task takes its texts some megabytes at a time and cuts them into words as
the tokenizer does. The words that this Python worker does not remember lie in
one flat array of symbols; in each round every word merges its lowest-ranked
pair wherever it stands, all words at once. Ranks are found by binary search
over the sorted keys of the merge table, again only next to what has merged.
Words that have no pair left leave the array. Ids, and the bytes when
decoding, are gathered from flat arrays, so no loop runs over tokens.

Merging all places of the lowest pair in one round is what merging one pair
at a time comes to, provided that a pair ranks above the merges that made its
halves; this is checked when the file is loaded. A word of more than
``LONG_WORD`` bytes is first cut wherever no token holds the bytes around the
cut, which leaves its ids as they are and saves rounds.

The tokenizer's file decides the words: its own splitter is asked about every
character when it first occurs, and a text with a character for which the
``regex`` module has another class is cut by that splitter itself.

Defined results: a NULL or empty text has no ids, and no ids decode to the
empty text; a NULL doc_id is carried along; repeated rows are encoded as often
as they occur; an empty table gives an empty result; ids that are NULL or
outside the vocabulary decode to nothing, bytes that are not UTF-8 to U+FFFD;
columns besides doc_id and text (ids for decoding) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

# Words and bytes of words that a Python worker remembers before it starts anew.
MEMO_WORDS = 200_000
MEMO_BYTES = 4 << 20
LONG_WORD = 64
NEVER = (1 << 31) - 1


def default_path() -> str:
    """The byte-level tokenizer's file where the public files are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_pattern(letter: str, digit: str, other: str) -> str:
    """The words of byte-level BPE; contractions are the splitter's own."""
    contractions = "|".join("'" + c for c in ("s", "t", "re", "ve", "m", "ll", "d"))
    return rf"{contractions}| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"


def spread(lengths, starts):
    """The positions of runs (start, length), one run after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Merges:
    """The merge table as sorted arrays, and the rounds over flat symbols."""

    def __init__(self, vocab: dict[str, int], merges: list, bytes_of: dict[str, int]):
        import numpy as np

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        maker = np.full(self.size, -1, np.int64)
        maker[made] = np.arange(len(made))
        if len(set(made.tolist())) < len(made) or (np.maximum(maker[left], maker[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge ranks below one that makes its halves")
        key = left * self.size + right
        order = np.argsort(key)
        # A key above all others keeps the search in range.
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, NEVER).astype(np.int32)
        self.made = np.append(made, 0).astype(np.int32)
        self.first = np.zeros(256, np.int32)
        for name, byte in bytes_of.items():
            self.first[byte] = vocab[name]
        held = [bytes(map(bytes_of.__getitem__, t)) for t in vocab if all(c in bytes_of for c in t)]
        self.pairs = np.zeros(1 << 16, bool)
        self.triples = np.zeros(1 << 24, bool)
        for t in held:
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = True
            for a, b, c in zip(t, t[1:], t[2:]):
                self.triples[a << 16 | b << 8 | c] = True

    def rank(self, sym, at):
        """Ranks of the pairs that begin at ``at``."""
        import numpy as np

        key = sym[at].astype(np.int64) * self.size + sym[at + 1]
        found = self.keys.searchsorted(key)
        return np.where(self.keys[found] == key, self.ranks[found], NEVER)

    def cuts(self, raw, starts, lengths):
        """Starts of the parts of the words: the long ones cut wherever no
        token can lie across."""
        import numpy as np

        far = lengths > LONG_WORD
        if not far.any():
            return starts
        at = spread(lengths[far] - 1, starts[far] + 1)
        a, b = raw[at - 1].astype(np.int64), raw[at].astype(np.int64)
        # At a word's ends the triple takes a foreign byte: at most a cut less.
        before = raw[np.maximum(at - 2, 0)].astype(np.int64)
        after = raw[np.minimum(at + 1, len(raw) - 1)].astype(np.int64)
        joined = self.pairs[a << 8 | b] | self.triples[before << 16 | a << 8 | b] | self.triples[a << 16 | b << 8 | after]
        return np.sort(np.concatenate([starts, at[~joined]]))

    def encode(self, words: list[bytes]):
        """(ids of all words one after the other, number of ids of each)."""
        import numpy as np

        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), lengths
        starts = np.cumsum(lengths) - lengths
        parts = self.cuts(raw, starts[lengths > 0], lengths[lengths > 0])
        sym = self.first[raw]
        place = np.arange(len(sym))
        part = np.zeros(len(sym), np.int64)
        part[parts[1:]] = 1
        part = np.cumsum(part)
        rank = np.full(len(sym), NEVER, np.int32)
        inner = np.flatnonzero(part[1:] == part[:-1])
        rank[inner] = self.rank(sym, inner)
        done_sym, done_place = [], []
        while len(sym):
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            best = np.repeat(best, sizes)
            open_ = best != NEVER
            if not open_.all():
                done_sym.append(sym[~open_])
                done_place.append(place[~open_])
                sym, place, part, rank, best = (x[open_] for x in (sym, place, part, rank, best))
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == best)
            # Of overlapping places, every other one from the left.
            run = np.concatenate(([True], np.diff(hits) > 1))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            sym[hits] = self.made[rank[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            new = (np.cumsum(keep) - 1)[hits]
            sym, place, part, rank = (x[keep] for x in (sym, place, part, rank))
            near = np.concatenate([new, new[new > 0] - 1])
            rank[near] = NEVER
            near = near[near < len(sym) - 1]
            rank[near] = np.where(part[near] == part[near + 1], self.rank(sym, near), NEVER)
        sym, place = np.concatenate(done_sym), np.concatenate(done_place)
        sym = sym[np.argsort(place, kind="stable")]
        return sym, np.bincount(np.searchsorted(starts, np.sort(place), side="right") - 1, minlength=len(words))


class Codec:
    """Texts to ids and back, as the tokenizer of one file does."""

    def __init__(self, path: str | None):
        import json
        import re

        import numpy as np
        import regex
        from tokenizers import Tokenizer

        path = path or default_path()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                                      "ignore_merges")] + [spec["normalizer"], splitter.get("add_prefix_space")]
        odd += [t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
        if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or not splitter.get("use_regex") or any(odd):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        bytes_of = {name: byte for byte, name in tokens.byte_letters().items()}
        self.merges = Merges(model["vocab"], model["merges"], bytes_of)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_of = re.compile("(" + "|".join(map(re.escape, by_length)) + ")").split if by_length else None
        self.words_of = regex.compile(word_pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")).findall
        self.ascii_words_of = re.compile(word_pattern("[A-Za-z]", "[0-9]", r"[^\sA-Za-z0-9]"), re.ASCII).findall
        self.alike: set[str] = set(map(chr, range(128)))
        self.unlike: set[str] = set()
        text_of = {i: t.encode() for t, i in self.special.items()}
        for t, i in model["vocab"].items():
            text_of[i] = bytes(map(bytes_of.__getitem__, t)) if all(c in bytes_of for c in t) else t.encode()
        most = max(text_of) + 1
        names = [text_of.get(i, b"") for i in range(most)] + [b""]
        self.name_length = np.array([len(n) for n in names], np.int64)
        self.name_start = np.cumsum(self.name_length) - self.name_length
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.forget()

    def forget(self) -> None:
        import numpy as np

        pending = self.pending = []

        class Memo(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                pending.append(word)
                return n

        self.memo, self.held = Memo(), 0
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def _split_alike(self, chars: set[str]) -> bool:
        """Whether the ``regex`` module has these characters in the classes
        that the splitter has them in."""
        for c in chars - self.alike - self.unlike:
            probe = f"a{c}1{c}{c} {c}! {c}  {c} b"
            parts = [probe[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(probe)]
            (self.alike if parts == self.words_of(probe) else self.unlike).add(c)
        return not chars & self.unlike

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words_of(text)
        if self._split_alike(set(text)):
            return self.words_of(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _numbers(self, text: str) -> list[int]:
        """The text's words as numbers in the memo; a special id i is -1 - i."""
        if self.special_of is None:
            return list(map(self.memo.__getitem__, self._words(text)))
        found = []
        for nth, part in enumerate(self.special_of(text)):
            if nth % 2:
                found.append(-1 - self.special[part])
            else:
                found.extend(map(self.memo.__getitem__, self._words(part)))
        return found

    def encode_many(self, texts: list[str | None]):
        """(ids of all texts one after the other, number of ids of each)."""
        import itertools

        import numpy as np

        numbers = [self._numbers(t) if t else [] for t in texts]
        if self.pending:
            words = [w.encode() for w in self.pending]
            self.held += sum(map(len, words))
            ids, counts = self.merges.encode(words)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.pending.clear()
        first = np.cumsum(self.counts) - self.counts
        sizes = np.array([len(n) for n in numbers], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        special = flat < 0
        if special.any():
            word = np.where(special, 0, flat)
            counts = np.where(special, 1, self.counts[word]) if len(self.counts) else np.ones(len(flat), np.int64)
            begin = first[word] if len(first) else np.zeros(len(flat), np.int64)
            ids = np.append(self.ids, 0)[np.minimum(spread(counts, begin), len(self.ids))]
            ids[(np.cumsum(counts) - counts)[special]] = -1 - flat[special]
        else:
            counts = self.counts[flat]
            ids = self.ids[spread(counts, first[flat])]
        upto = np.append(0, np.cumsum(counts))
        ends = np.cumsum(sizes)
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_BYTES:
            self.forget()
        return ids, upto[ends] - upto[ends - sizes]

    def decode_many(self, ids, counts) -> tuple:
        """(bytes of all texts one after the other, number of bytes of each)."""
        import numpy as np

        ids = np.where((ids < 0) | (ids >= len(self.name_length)), len(self.name_length) - 1, ids)
        sizes = self.name_length[ids]
        upto = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(counts)
        return self.names[spread(sizes, self.name_start[ids])], upto[ends] - upto[ends - counts]


def worker_codec(path: str | None) -> Codec:
    """This Python worker's codec: its memo lives on from task to task."""
    import sys
    import types

    store = sys.modules.setdefault("_tidewater_worker", types.ModuleType("_tidewater_worker")).__dict__
    if ("codec", path) not in store:
        store["codec", path] = Codec(path)
    return store["codec", path]


def _offsets(counts):
    """Arrow offsets of consecutive lists or texts."""
    import numpy as np
    import pyarrow as pa

    return pa.py_buffer(np.append(0, np.cumsum(counts)).astype(np.int32))


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text of ``docs``."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        codec = worker_codec(tokenizer_path)
        for part in parts:
            keys = part.column("doc_id")
            for first, texts in tokens.batches(part.column("text")):
                ids, counts = codec.encode_many([t.decode("utf-8", "replace") if t else None for t in texts])
                lists = pa.Array.from_buffers(pa.list_(pa.int32()), len(texts), [None, _offsets(counts)],
                                              children=[pa.array(ids, pa.int32())])
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), lists], names=["doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the text that the ``ids`` of each row stand for."""

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = worker_codec(tokenizer_path)
        for part in parts:
            lists = part.column("ids")
            counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            raw, sizes = codec.decode_many(np.asarray(lists.flatten().fill_null(-1)), counts)
            texts = pa.Array.from_buffers(pa.binary(), len(part), [None, _offsets(sizes), pa.py_buffer(raw)])
            try:
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], names=["doc_id", "ids", "decoded"])

    narrow = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    both = decode(encode(docs, tokenizer_path), tokenizer_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
