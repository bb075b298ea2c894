from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from requestmarts.llm import decontaminate as d
from tests.llm.helpers import awkward, documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(item_id)} - {"None"}
    n = len(hit)
    return (len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(words))


def compare(spark, docs, items):
    """Items sent to the tasks, and joined by shuffles, against brute force."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for item_bytes in (d.ITEM_BYTES, 0):
        found = rows(d.decontaminate(documents(spark, docs), bench, item_bytes=item_bytes))
        assert sorted(((r["doc_id"], *(r[f] for f in fields)) for r in found), key=str) == want
        kept = rows(d.clean_documents(documents(spark, docs), bench, item_bytes))
        assert sorted((str((r["doc_id"], r["text"])) for r in kept)) == sorted(
            str((i, t)) for i, t in docs if not brute(t, items)[4]
        )
    return found


def test_equals_brute_force_with_short_long_null_and_repeated_items(spark):
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(12)] + ["Ä", "b-c"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 30, 60])]
    items += [(3, items[9][1]), (None, items[8][1]), (77, None), (78, ""), (79, items[8][1])]
    docs = awkward() + [(100 + i, text(rnd.randint(0, 120))) for i in range(20)]
    docs += [(200 + i, f"{text(9)} {(items[rnd.randrange(5, 10)][1]).upper()}; {text(25)}") for i in range(15)]
    docs += [(300, "w1 " * 400), (301, docs[-1][1]), (301, docs[-1][1])]
    found = compare(spark, docs, items)
    assert any(r["contaminated"] for r in found) and not all(r["contaminated"] for r in found)


def test_edges_of_a_window(spark):
    item = " ".join(f"i{n}" for n in range(20))
    docs = [(1, " ".join(f"i{n}" for n in range(a, a + k)) + " other") for a in (0, 3, 7) for k in (12, 13, 14)]
    compare(spark, docs, [(5, item)])


def test_one_repeated_word_and_an_item_in_every_document(spark):
    """Places of a repeated word are kept by diagonal; nothing holds all their pairs."""
    common = " ".join(f"c{n}" for n in range(15))
    items = [(1, "w " * 60), (2, "w " * 13), (3, common), (4, "w " * 12), (5, "w x " * 30)]
    docs = [(0, "w " * 20_000), (1, "x w " * 3000)] + [(10 + i, f"own{i} {common} tail{i}") for i in range(60)]
    small = [(i, t if i > 1 else t[:800]) for i, t in docs]
    compare(spark, small, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for item_bytes in (d.ITEM_BYTES, 0):
        found = {r["doc_id"]: r for r in rows(d.decontaminate(documents(spark, docs), bench, item_bytes=item_bytes))}
        assert (found[0]["n_words"], found[0]["n_hit"], found[0]["n_items"]) == (20_000, 20_000, 3)
        assert (found[1]["n_words"], found[1]["n_hit"], found[1]["n_items"]) == (6000, 6000, 1)
        assert all(found[10 + i]["n_hit"] == 15 for i in range(60))


def test_small_benchmarks_shuffle_nothing(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = d.decontaminate(documents(spark, ["a b c d"]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rows(d.decontaminate(documents(spark, []), bench)) == []
    [row] = rows(d.decontaminate(documents(spark, ["a b"]), bench))
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (0, 0, False)


@pytest.mark.parametrize("w", [1, 2, 5, 9])
def test_every_window_keeps_a_hash_and_equal_windows_the_same(w):
    hashes = np.random.default_rng(w).integers(0, 6, 400).astype(np.uint64)
    kept = set(d.winnowed(hashes, w).tolist())
    for i in range(len(hashes) - w + 1):
        last = max(j for j in range(i, i + w) if hashes[j] == hashes[i : i + w].min())
        assert last in kept
