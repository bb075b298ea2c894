from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction

from requestmarts.llm import mixing
from tests.llm.helpers import SCHEMA, rows


def brute_share(children, given):
    """Budget by child; children: name -> (capacity, weight)."""
    open_, rest, out = dict(children), given, {}
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c <= Fraction(rest * w, total)]
        if not full:
            return out | {n: rest * w // total for n, (_, w) in open_.items()}
        first = min(full, key=lambda n: (Fraction(open_[n][0], open_[n][1]), n))
        out[first] = open_[first][0]
        rest -= open_.pop(first)[0]
    return out


def brute(docs, weights, percent, max_epochs, seed):
    """docs: (doc_id, domain, lang, source, text)."""
    tokens = lambda t: len((t or "").split())
    leaf = lambda d: (d[1], d[2] or "?", d[3] or "?")
    size = defaultdict(int)
    for d in docs:
        size[leaf(d)] += tokens(d[4])
    total = sum(size.values())
    budget = {(): min(total * percent // 100, total * max_epochs)}
    for depth in (1, 2, 3):
        capacity = defaultdict(int)
        for k, n in size.items():
            capacity[k[:depth]] += n * max_epochs
        for parent in {k[:-1] for k in capacity}:
            kids = {k: (c, weights.get("/".join(k), 1)) for k, c in capacity.items() if k[:-1] == parent}
            budget |= brute_share(kids, budget[parent])
    out = []
    for k, n in size.items():
        whole, part = divmod(budget[k], n) if n else (1, 0)
        digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
        key = lambda d: (hashlib.md5(f"{seed}:{whole}:{d[0]}:{digest(d[4])}".encode()).hexdigest(), d[0])
        upto = 0
        for d in sorted((d for d in docs if leaf(d) == k), key=key):
            out.append((d[0], budget[k], min(max_epochs, whole + (upto < part))))
            upto += tokens(d[4])
    return sorted(out)


def test_equals_brute_force(spark):
    docs = [(i, ("a b c " * (i % 7)) if i % 11 else None, [None, "en", "de"][i % 3], f"s{i * i % 5}") for i in range(120)]
    frame = spark.createDataFrame([(i, t, x, s, *[None] * 8) for i, t, x, s in docs], SCHEMA)
    for percent, epochs in ((30, 1), (100, 1), (170, 2), (500, 3)):
        found = rows(mixing.mix(frame, {"d0": 9, "d1/en": 4}, percent, epochs, seed=3))
        domains = {r["doc_id"]: r["domain"] for r in found}
        expected = brute([(i, domains[i], x, s, t) for i, t, x, s in docs], {"d0": 9, "d1/en": 4}, percent, epochs, 3)
        assert sorted((r["doc_id"], r["leaf_budget"], r["copies"]) for r in found) == expected


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # en is short; its sibling de takes the rest, the other domain gets no more than its half.
    texts = [("d0", "en", 10), ("d0", "de", 100), ("d1", "en", 200)]
    leaves = spark.createDataFrame([(d, x, "s", n) for d, x, n in texts], "domain string, lang string, source string, tokens long")
    none = spark.createDataFrame([], "node string, weight long")
    budget = lambda p: {r.node: int(r.budget) for r in mixing.leaf_budgets(leaves, none, p, 1).collect()}
    assert budget(50) == {"d0/en/s": 10, "d0/de/s": 67, "d1/en/s": 77}
    assert budget(90) == {"d0/en/s": 10, "d0/de/s": 100, "d1/en/s": 169}


def test_a_leaf_spends_its_budget_and_less_than_a_document_more(spark, sf_dir):
    found = rows(mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    leaves = defaultdict(list)
    for r in found:
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    for own in leaves.values():
        spent = sum(r["copies"] * r["n_tokens"] for r in own)
        assert own[0]["leaf_budget"] <= spent < own[0]["leaf_budget"] + max(r["n_tokens"] for r in own)


def test_main_path_runs_no_python(spark, sf_dir):
    df = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_table_and_null_columns(spark):
    assert rows(mixing.mix(spark.createDataFrame([], SCHEMA))) == []
    [row] = rows(mixing.mix(spark.createDataFrame([tuple([None] * 12)], SCHEMA)))
    assert (row["lang"], row["source"], row["n_tokens"]) == ("?", "?", 0)


def test_sampled_rows_with_the_same_id_and_text_stay_themselves(spark):
    given = [(i % 4, f"a b c {i % 4}", "en", "s", i, *[None] * 7) for i in range(24)] + [(9, "x y", "en", "s", 99, *[None] * 7)]
    frame = spark.createDataFrame(given, SCHEMA)
    taken = lambda percent, epochs: [r.n_chars for r in mixing.sampled_documents(frame, {}, percent, epochs).collect()]
    assert sorted(taken(100, 1)) == sorted(r[4] for r in given)
    assert sorted(taken(200, 2)) == sorted([r[4] for r in given] * 2)
    for percent, epochs in ((50, 1), (150, 2)):
        copies = sum(r["copies"] for r in rows(mixing.mix(frame, {}, percent, epochs)))
        found = taken(percent, epochs)
        assert len(found) == copies
        assert max(map(found.count, found)) == epochs and (epochs == 1 or set(found) == {r[4] for r in given})
