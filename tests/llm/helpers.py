"""Small tables with the awkward cases, and row collection."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, key string, hash long, size string, n string, label string, score string"


def documents(spark, texts, first=0):
    """A documents table with extra columns whose names clash with the operators' own."""
    rows = [
        (i if i is None else i, t, "en", "src", None, "x", "y", None, "z", None, "l", "s")
        for i, t in (x if isinstance(x, tuple) else (n + first, x) for n, x in enumerate(texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(seed=0):
    """Nulls, empty and long texts, repeated rows, null and repeated ids."""
    rnd = random.Random(seed)
    long_text = " ".join(rnd.choice(["alpha", "beta", "gamma", "MIT", "License", "x1"]) for _ in range(20_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "other words"), (None, "one"), (None, None),
        (5, long_text), (6, long_text), (7, "a" * 30_000), (8, "Ünïcode ǅ ß 中文 \x00 𝔘 é İΣ"), (9, "!!! *** ###"),
    ]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
