"""Awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, component long, line string, sig string, rep long, kept boolean, key string, positions int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = [rng.choice(words) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + 12]) for i in range(0, n, 12))


BASE = prose(1, 240)
NEAR = BASE.replace(BASE.split()[100], "changed", 1)
LONG = prose(2, 30_000)
LINES = "\n".join([prose(3, 30), "the same line again and again here", "the same line again and again here", prose(4, 30)])

TEXTS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, NEAR, "en", "b"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t\x0b ", "de", None),
    (7, "x", "fr", "b"),
    (8, LONG, "de", "c"),
    (9, LINES, "es", "a"),
    (None, BASE, "en", "a"),
    (1, BASE, "en", "a"),
    (10, "é ü 漢字 \u00a0 nbsp 🙂 <|endoftext|> tail", None, "b"),
    (11, "w" * 20_000, "en", None),
]


def documents(spark, rows=TEXTS):
    full = [(i, t, g, s, None if t is None else len(t), 1, "z", 2, "l", "s", 3, True, "k", 4) for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
