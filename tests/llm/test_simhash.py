from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from requestmarts.llm import simhash
from requestmarts.llm.components import components
from requestmarts.llm.queries import op3_covering_anchors
from tests.llm.helpers import awkward, documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint) -> component of each row."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    ids = {}
    for i, f in pairs:
        if i is not None:
            ids[find(f)] = min(i, ids.get(find(f), i))
    return [ids.get(find(f)) for _, f in pairs]


def expected(given):
    pairs = [(i, brute_fingerprint(t)) for i, t in given]
    return sorted(((i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs), strict=True)), key=str)


def test_awkward_rows_equal_brute_force(spark):
    given = awkward() + [(50, "A  b c\td e"), (51, "a b c d e"), (52, "x y z")]
    found = rows(simhash.near_duplicates(documents(spark, given)))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == expected(given)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    found = rows(op3_covering_anchors(spark, sf_dir))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == expected(given)


def clustered(seed, n):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 40])):
            x = base
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            out.add(x)
            base = rnd.choice([base, x])
    return sorted(out)


def test_links_span_every_component_also_when_anchors_are_cut_into_blocks(spark):
    prints = clustered(4, 900)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components([(i, f) for i, f in enumerate(prints)])
    for block in (4096, 5):
        edges = simhash.links(frame, block)
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in edges.collect())
        roots = {r.node: r.root for r in components(edges).collect()}
        groups = {}
        for x, c in zip(signed, want, strict=True):
            groups.setdefault(c, set()).add(roots.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_pair_within_two_bits_shares_an_anchor():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**31, 300)
    other = words.copy()
    for _ in range(2):
        other ^= np.int64(1) << rng.integers(0, 31, 300)
    for a, b in zip(words, other, strict=True):
        index, found = simhash.anchors(np.array([a, b]))
        assert set(found[index == 0]) & set(found[index == 1])
        assert all(int(a ^ c).bit_count() <= 2 for c in found[index == 0])
        assert len(found[index == 0]) in (1, 16)


def test_one_document_of_each_group_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rows(simhash.near_duplicates(docs))
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r["component_id"] for r in found})


def test_one_of_repeated_rows_and_null_ids_stays(spark):
    given = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "q w e r t"), (None, "q w e r t"), (None, None), (3, "z x c v b n")]
    kept = rows(simhash.keep_one_of_each_group(documents(spark, given)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [
        ("1", "a b c d e"), ("3", "z x c v b n"), ("None", "q w e r t")
    ]
    assert len(kept) == 4


def test_long_chains_and_empty_tables(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(n + 1)}
    star = spark.createDataFrame([(50, i) for i in range(50)] + [(100 + i, 50) for i in range(30)], "a long, b long")
    for hub_degree in (3, 10**6):
        assert {r.root for r in components(star.union(chain), hub_degree).collect()} == {0}
        assert {(r.node, r.root) for r in components(star, hub_degree).collect()} == {
            (i, 0) for i in [*range(51), *range(100, 130)]
        }
    assert components(chain.limit(0)).collect() == []
    assert rows(simhash.near_duplicates(documents(spark, []))) == []
