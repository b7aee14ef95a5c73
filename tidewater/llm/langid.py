"""Language identification by a byte convolutional network.

Filters of several widths slide over the raw UTF-8 bytes of fixed-length
windows; each filter's largest response over a window feeds a softmax layer.
The network is trained in numpy on the driver, on a bounded sample of
labelled rows (``Settings.per_language`` documents a language, one excerpt of
``Settings.excerpt`` characters each). Prediction reads every window of every
text inside the scan tasks: a document's log-probabilities are the mean over
its windows, weighted by their bytes. Nothing is shuffled for it.

The corpus stage drops texts without a letter, and texts that the network is
less sure of than of any held-out labelled document, all of which are scored:
a clean document falls below that score once in (their number + 1) times. Below
``Settings.least_rows`` such documents this bound says little, and the score
drops nothing; nor does it where there is no labelled row to learn from.

Defined results: NULL texts and texts without a letter are ``und`` with score
0; so is every text when no labelled row exists. A NULL doc_id is neither held
out nor learned from. Repeated rows are predicted one by one; ties go to the
language first in code point order; an empty table gives an empty result.
Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    per_language: int = 1200
    salts: int = 64
    excerpt: int = 512
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    least_rows: int = 300


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, s: Settings) -> list[tuple[str, bytes]]:
    """(language, excerpt) of at most ``per_language`` documents a language,
    chosen and placed by a hash of the id."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    salt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(s.seed + 2)), F.lit(s.salts))
    ids = known.select("doc_id", "lang", salt.alias("_salt"))
    # In two levels: a frequent language's rows never meet in one task.
    for level in (["lang", "_salt"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*level).orderBy(order, "doc_id"))
        ids = ids.withColumn("_nth", nth).where(F.col("_nth") <= s.per_language).drop("_nth")
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    at = F.pmod(F.xxhash64(F.col("_id"), F.lit(s.seed + 1)), F.greatest(F.length("text") - s.excerpt + 1, F.lit(1)))
    # per_language rows a language at most: a proven bound for the broadcast.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))) \
        .where(F.col("text").rlike("\\p{L}")) \
        .select("_id", "_lang", F.col("text").substr((at + 1).cast("int"), F.lit(s.excerpt)).alias("part")).distinct().collect()
    return sorted((r["_lang"], r["part"].encode("utf-8", "replace")) for r in rows)


def windows_of(raw: bytes, size: int):
    """All windows of a text, the last one padded with zero bytes."""
    import numpy as np

    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


def train(sample: list[tuple[str, bytes]], s: Settings) -> dict:
    """Fit the network by Adam on the cross entropy of single windows."""
    import numpy as np

    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return {"languages": [], "settings": s}
    x, y = [], []
    for lang, raw in sample:
        w = windows_of(raw, s.window)
        x.append(w)
        y += [languages.index(lang)] * len(w)
    x, y = np.concatenate(x), np.array(y)
    # The zero byte pads: its weights stay zero.
    full = (x != 0).sum(axis=1) >= s.window // 4
    if all((y[full] == k).any() for k in range(len(languages))):
        x, y = x[full], y[full]
    rng = np.random.default_rng(s.seed)
    f, n_lang = s.filters, len(languages)
    p = {f"conv{w}": rng.normal(0, 0.1, (w, 256, f)).astype(np.float32) for w in s.widths}
    p |= {f"bias{w}": np.zeros(f, np.float32) for w in s.widths}
    p["out"] = rng.normal(0, 0.1, (f * len(s.widths), n_lang)).astype(np.float32)
    p["out_bias"] = np.zeros(n_lang, np.float32)
    for w in s.widths:
        p[f"conv{w}"][:, 0] = 0
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), s.batch):
            b = x[order[i:i + s.batch]]
            t = y[order[i:i + s.batch]]
            rows = np.arange(len(b))
            feats, best = [], {}
            for w in s.widths:
                n = s.window - w + 1
                r = p[f"conv{w}"][0][b[:, :n]]
                for j in range(1, w):
                    r += p[f"conv{w}"][j][b[:, j:j + n]]
                best[w] = r.argmax(axis=1)
                feats.append(np.maximum(np.take_along_axis(r, best[w][:, None], 1)[:, 0] + p[f"bias{w}"], 0))
            h = np.concatenate(feats, axis=1)
            z = h @ p["out"] + p["out_bias"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[rows, t] -= 1
            q /= len(b)
            g = {"out": h.T @ q, "out_bias": q.sum(axis=0)}
            back = (q @ p["out"].T) * (h > 0)
            for k, w in enumerate(s.widths):
                d = back[:, k * f:(k + 1) * f]
                g[f"bias{w}"] = d.sum(axis=0)
                gc = np.zeros((w, 256, f), np.float32)
                for j in range(w):
                    np.add.at(gc[j], (b[rows[:, None], best[w] + j], np.arange(f)[None, :]), d)
                gc[:, 0] = 0
                g[f"conv{w}"] = gc
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                p[k] -= s.rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
    return {"languages": languages, "settings": s, **{k: a.astype(np.float32) for k, a in p.items()}}


class Predictor:
    """The trained network inside a task.

    The responses to a pair of neighbouring bytes are added up once per pair
    value, so a filter of width 4 costs two look-ups a position.
    """

    def __init__(self, model: dict):
        self.model = model
        self.s = model["settings"]
        self.pairs = {w: [self._pair(model[f"conv{w}"], j) for j in range(0, w, 2)] for w in self.s.widths}

    @staticmethod
    def _pair(conv, j):
        if j + 1 == len(conv):
            return conv[j]
        return (conv[j][:, None, :] + conv[j + 1][None, :, :]).reshape(256 * 256, -1)

    def log_probabilities(self, x):
        """Per window; ``x`` is windows by bytes."""
        import numpy as np

        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        feats = []
        for w in self.s.widths:
            n = self.s.window - w + 1
            r = None
            for t, j in zip(self.pairs[w], range(0, w, 2)):
                at = x[:, j:j + n] if len(t) == 256 else pair[:, j:j + n]
                part = np.take(t, at, axis=0)
                r = part if r is None else np.add(r, part, out=r)
            feats.append(np.maximum(r.max(axis=1) + self.model[f"bias{w}"], 0))
        z = (np.concatenate(feats, axis=1) @ self.model["out"] + self.model["out_bias"]).astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes | None], at_once: int = 256) -> list[tuple[str, float]]:
        """Language and score of each whole text; None is unknown."""
        import numpy as np

        size, n_lang = self.s.window, len(self.model["languages"])
        total = np.zeros((len(texts), n_lang))
        parts, owners, weights, held = [], [], [], 0

        def flush():
            nonlocal parts, owners, weights, held
            if parts:
                x, own, wt = np.concatenate(parts), np.concatenate(owners), np.concatenate(weights)
                for i in range(0, len(x), at_once):
                    lp = self.log_probabilities(x[i:i + at_once]) * wt[i:i + at_once, None]
                    np.add.at(total, own[i:i + at_once], lp)
            parts, owners, weights, held = [], [], [], 0

        for k, raw in enumerate(texts):
            if raw is None:
                continue
            x = windows_of(raw, size)
            wt = np.full(len(x), float(size))
            wt[-1] = len(raw) - size * (len(x) - 1)
            parts.append(x)
            owners.append(np.full(len(x), k))
            weights.append(wt / max(1, len(raw)))
            held += len(x)
            if held >= 16 * at_once:
                flush()
        flush()
        out = []
        for raw, z in zip(texts, total):
            if raw is None:
                out.append((UNKNOWN, 0.0))
            else:
                q = np.exp(z - z.max())
                k = int(q.argmax())
                out.append((self.model["languages"][k], float(q[k] / q.sum())))
        return out


def fit(docs: DataFrame, settings: Settings = Settings()) -> dict:
    """Train on the labelled rows of ``docs`` that are not held out."""
    return train(training_sample(docs, settings), settings)


def classify(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``_lang`` and ``_score`` of its text."""
    usable = F.col("text").rlike("\\p{L}") & F.lit(bool(model["languages"]))
    narrow = docs.select(*columns, F.when(usable, F.col("text")).alias("_read"))

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        net = Predictor(model) if model["languages"] else None
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                texts = some.column("_read").cast(pa.binary()).to_pylist()
                found = net.predict(texts) if net else [(UNKNOWN, 0.0)] * len(texts)
                names = [c for c in some.schema.names if c != "_read"]
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in names]
                    + [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                    names=[*names, "_lang", "_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "_read")
    return narrow.mapInArrow(run, fields + ", _lang string, _score double")


def predict_languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = classify(docs.select("doc_id", "text"), fit(docs, settings), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def lowest_score(docs: DataFrame, model: dict) -> float:
    """The lowest score of all held-out documents with a learned label; 0 where
    fewer than ``Settings.least_rows`` are there."""
    s = model["settings"]
    known = held_out(F.col("doc_id")) & F.col("lang").isin(model["languages"])
    seen = classify(docs.where(known), model, ["doc_id"]).where(F.col("_lang") != UNKNOWN) \
        .agg(F.count_distinct("doc_id").alias("n"), F.min("_score").alias("low")).first()
    # Sums in another order may differ by this much.
    return max(0.0, seen["low"] - 1e-4) if seen["n"] >= s.least_rows else 0.0


def keep_known(docs: DataFrame, least_score: float | None = None, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that have no letter or whose score is
    below ``least_score`` (``lowest_score`` if not given); all columns stay."""
    model = fit(docs, settings)
    if not model["languages"]:
        return docs.where(F.col("text").rlike("\\p{L}"))
    least = lowest_score(docs, model) if least_score is None else least_score
    found = classify(docs, model, docs.columns)
    return found.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least)).drop("_lang", "_score")
