from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from requestmarts.llm import suffixes
from requestmarts.llm.queries import op10_column_wise
from tests.llm.helpers import awkward, documents, rows


def brute(texts, window=400):
    """(n_bytes, removed runs, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        runs = []
        for i in range(len(r) - window + 1):
            if times[r[i : i + window]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + window
                else:
                    runs.append([i, i + window])
        edges = [0, *[e for x in runs for e in x], len(r)]
        out.append((len(r), runs, b"".join(r[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
    return out


def planted(seed):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [noise(n) for n in (350, 380, 398, 420, 700, 1500)]
    texts = []
    for i in range(40):
        text = noise(rnd.randint(0, 900))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            start = rnd.randrange(0, 60)
            text += p[start : start + rnd.randint(300, 1500)] + noise(rnd.randint(0, 500))
        texts.append(text)
    texts += [texts[3], texts[3], texts[5][:-1], "x" + texts[5], noise(399), "ab" * 900, "z" * 1200]
    return texts


def compare(spark, given, **options):
    found = rows(suffixes.remove_repeats(documents(spark, given), **options))
    want = brute([t for _, t in given])
    assert sorted(((r["doc_id"], r["n_bytes"], r["removed"], bytes(r["kept"])) for r in found), key=str) == sorted(
        ((i, *w) for (i, _), w in zip(given, want, strict=True)), key=str
    )
    return want


def test_planted_passages_equal_brute_force(spark):
    want = compare(spark, list(enumerate(planted(1))))
    assert any(runs for _, runs, _ in want) and any(not runs for _, runs, _ in want)


def test_large_collections_are_counted_by_window(spark):
    compare(spark, list(enumerate(planted(2))), together=3)


def test_awkward_rows_equal_brute_force(spark):
    given = [(i, t) for i, t in awkward() if i not in (5, 6)] + [(60, "é" * 199), (61, "é" * 200), (62, "é" * 200)]
    compare(spark, given)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in docs])
    found = op10_column_wise(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == [
        (d.doc_id, n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest())
        for d, (n, runs, kept) in zip(docs, want, strict=True)
    ]


def test_column_wise_rounds_find_the_shared_windows_of_a_collection():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 3, (12, 60)).astype(np.uint16)
    groups = np.sort(rng.integers(0, 4, 60))
    first, last = suffixes.repeated_windows(symbols, groups, 3)
    for i in range(60):
        at = [
            c for c in range(10)
            if (symbols[c : c + 3, i] > 0).all()
            and any(j != i and groups[j] == groups[i] and (symbols[c : c + 3, j] == symbols[c : c + 3, i]).all() for j in range(60))
        ]
        assert (first[i], last[i]) == ((at[0], at[-1]) if at else (-1, -1))


def test_equal_windows_have_their_anchor_at_the_same_place():
    raw = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8)
    raw[3000:3600] = raw[100:700]
    at, _, first, last = suffixes.anchors(raw)
    of_window = np.repeat(at, last - first + 1)
    starts = np.arange(len(raw) - 399)
    assert len(of_window) == len(starts)
    assert ((of_window >= starts) & (of_window <= starts + 304)).all()
    assert (of_window[3000:3201] - 3000 == of_window[100:301] - 100).all()
    assert len(at) < 80


def test_periodic_text_is_few_rows_and_equals_brute_force(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    period, line = "onhe. Is ", noise(37) + "\n"
    texts = [noise(rnd.randint(0, 300)) + (u * 900)[: rnd.randint(380, 1500)] + noise(rnd.randint(0, 300)) for u in (period, line, "zz", period, line) for _ in range(4)]
    compare(spark, list(enumerate(texts)))
    assert len(suffixes.surroundings((period * 2000).encode())) < 70


def test_empty_table(spark):
    assert rows(suffixes.remove_repeats(documents(spark, []))) == []
