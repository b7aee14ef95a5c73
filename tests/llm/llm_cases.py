"""Small inputs shared by the tests of the training-data operators."""

import random

WORDS = "lorem ipsum dolor sit amet elit sed do tempor ut labore magna aliqua quis nostrud ullamco nisi velit".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns whose names clash
    with those that operators add."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, length string, piece string, "
              "size string, kept string, node string, score string, class string")
    full = [(*r, *[None] * (4 - len(r)), 1, "x", "x", "x", "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, schema)


def mixed_bag(seed: int = 0):
    """Nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, None, None, None), (21, "", "en", "s0"), (22, "   \n\t ", "fr", None), (23, "one two", "en", "s1"),
             (None, base[0], "en", "s1"), (None, "nobody", None, "s1"), (24, base[3].replace(" ", "  \n"), "en", "s2"),
             (25, base[3] + " tail", "en", "s2"), (5, base[5], "en", "s2"), (5, base[5], "en", "s2"),
             (26, prose(rng, 30_000), "en", "s0"), (27, "A" * 50_000, "de", "s1"), (28, "é ü ß 中文 " * 40, "de", "s2")]
    return rows
