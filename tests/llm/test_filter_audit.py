from __future__ import annotations

import math
import random
import re
from itertools import permutations

import pytest

from requestmarts.llm import filter_audit as audit
from tests.llm.helpers import SCHEMA, awkward, documents, rows

MARKS = "doc_id long, quality int, toxic int, text string, id string, n long"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" if len(words) < 100 else ""
    found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    return found + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(docs, labels):
    """Every order walked document by document; rows are (id, text, lang)."""
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    marked = []
    for i, t, part in docs:
        smaller = i is not None and any(u == t and j is not None and j < i for j, u, _ in docs)
        marked.append((part, fails(t) + "E" * smaller, i is not None and i in good, i is not None and i in toxic))
    out, removed_by = [], {}
    for part in sorted({m[0] for m in marked}):
        for order in permutations("ABCDE"):
            left = [m[1:] for m in marked if m[0] == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                out.append(
                    [part, "".join(order), step, len(left), len(gone), sum(f in m[0] for m in everyone) - len(gone),
                     sum(m[0] == f for m in everyone), sum(m[1] for m in gone), sum(m[2] for m in gone), f]
                )
    return sorted((*r[:-1], removed_by[r[0], r[-1]]) for r in out)


def found(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, lang, "s", 0, "x", "y", 1, "z", "n", "l", "s") for i, t, lang in docs], SCHEMA)
    marks = spark.createDataFrame([(i, q, x, "t", "i", 2) for i, q, x in labels], MARKS)
    return sorted(tuple(r.values()) for r in rows(audit.interactions(frame, marks)))


def test_equals_brute_force_with_copies_nulls_and_repeated_ids(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["UPPER CASE", "a#b", "x y", "É"]
    text = lambda n: rnd.choice([" ", "\n", "\t"]).join(rnd.choice(words[: rnd.choice([20, 404])]) for _ in range(n))
    texts = [text(rnd.choice([0, 5, 99, 100, 130])) for _ in range(25)]
    docs = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in rnd.sample(range(1000), 120)]
    docs += [(i, t, "en") for i, t in awkward() if i != 5 and i != 6]
    docs += docs[:7] + [(None, texts[0], "de"), (docs[0][0], texts[1], "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i, _, _ in docs if i and rnd.random() < 0.6]
    labels += [(None, 1, 1), (99999, 1, 1), (docs[1][0], 1, 0), (docs[1][0], 0, 1)]
    got = found(spark, docs, labels)
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})
    assert any(r[5] for r in got) and any(r[7] for r in got) and any(r[8] for r in got)


def test_limits_of_each_filter():
    hundred = " ".join(f"w{i}" for i in range(100)).encode()
    assert audit.text_failures(hundred) == 0
    assert audit.text_failures(hundred.rsplit(b" ", 1)[0]) == 1
    # 80 distinct of 100 pass, 79 fail.
    assert audit.text_failures(b" ".join([*hundred.split()[:80], *[b"w0"] * 20])) == 0
    assert audit.text_failures(b" ".join([*hundred.split()[:79], *[b"w0"] * 21])) == 2
    # Capitals against code points, not bytes.
    assert audit.text_failures(("A" + "é" * 9).encode()) & 4 == 0
    assert audit.text_failures(("A" + "é" * 8).encode()) & 4
    assert [audit.text_failures(c.encode()) & 8 for c in "#$%&*|@!"] == [8] * 6 + [0] * 2
    assert audit.text_failures(b"") == 1


def test_potential_equals_its_definition(spark):
    """The recursion over subsets against fractions, and against the marginals of all orders."""
    rnd = random.Random(2)
    removed = [0] + [rnd.randint(0, 1000) for _ in range(31)]
    values = spark.createDataFrame([("p", removed)], "part string, removed array<bigint>")
    [row] = rows(audit.potentials(values))
    from fractions import Fraction

    exact = [Fraction(0)] * 32
    for s in range(1, 32):
        exact[s] = (removed[s] + sum(exact[s & ~(1 << i)] for i in range(5) if s >> i & 1)) / Fraction(s.bit_count())
    assert row["potential"] == [math.factorial(s.bit_count()) * exact[s] for s in range(32)]
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += removed[before | 1 << i] - removed[before]
        assert row["potential"][31] - 5 * row["potential"][31 ^ (1 << i)] == total


def test_a_text_held_by_most_rows(spark):
    docs = [(i, "same text", "en" if i % 3 else None) for i in range(300)] + [(300 + i, f"own {i}", "en") for i in range(30)]
    assert found(spark, docs, [(5, 1, 1), (0, 1, 0)]) == brute(docs, [(5, 1, 1), (0, 1, 0)])


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_empty_tables(spark, labels):
    assert found(spark, [], labels) == []
    assert len(found(spark, [(1, None, None)], labels)) == 600


def test_documents_helper_columns_do_not_clash(spark):
    marks = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(rows(audit.interactions(documents(spark, ["a b", None]), marks))) == 600
