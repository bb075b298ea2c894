from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from requestmarts.llm import divergence as dv
from requestmarts.llm import transducer
from tests.llm.helpers import SCHEMA, awkward, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, least=10):
    """Rows are (text, lang, source)."""
    docs = [(terms_of(t), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held = Counter(t for words, own, _ in docs if own == lang for t in set(words))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for words, own, source in docs:
            if own == lang:
                counts[source].update(t for t in words if held[t] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s, own in counts.items():
            pairs = [(-sum(apart(share(own, t), share(o, t)) for t in kept), x.encode(), x) for x, o in counts.items() if x != s]
            over = [(-apart(share(own, t), share(whole, t)), t.encode(), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:10])):
                out += [(lang, s, part, x[2], -x[0], rank) for rank, x in enumerate(found, 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y", 1, "z", "n", "l", "s") for i, (t, lang, s) in enumerate(docs)], SCHEMA)


def found(spark, docs, least=10):
    return sorted(tuple(r.values()) for r in rows(dv.divergence(frame(spark, docs), least)))


def corpus(seed, n, sources, langs=("en", "de", None, "")):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("un", "Re", "é", "日本", "x") for b in ("do", "DOING", "ing", "", "ßen", "o-p")]
    text = lambda: rnd.choice([" ", "1", "\n"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 30])))
    docs = [(text(), rnd.choice(langs), rnd.choice([*sources, None])) for _ in range(n)]
    return docs + [(t, "en", "src") for _, t in awkward()] + [("only once", "fr", "a"), (None, "fr", "b"), ("", "it", "c")]


def test_equals_brute_force_with_ties_nulls_and_groups_without_terms(spark):
    docs = corpus(3, 150, ["a", "b", "c", "é", "B"])
    got = found(spark, docs)
    assert got == brute(docs)
    assert {r[2] for r in got} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in got


def test_tiles_blocks_slices_and_passes_do_not_show(spark, monkeypatch):
    docs = corpus(4, 120, ["a", "b", "c", "d", "e"])
    want = brute(docs, 4)
    for name, value in (("TILE", 2), ("BLOCK", 3), ("FLUSH", 20), ("CHUNK", 50)):
        monkeypatch.setattr(dv, name, value)
    assert found(spark, docs, 4) == want
    slices = dv.vocabulary(frame(spark, docs), 4, slice_bytes=40)
    assert slices.select("slice").distinct().count() > 4
    want_counts = rows(dv.recounted(frame(spark, docs), dv.vocabulary(frame(spark, docs), 4)))
    got_counts = rows(dv.recounted(frame(spark, docs), slices, pass_bytes=2000))
    assert sorted(map(str, got_counts)) == sorted(map(str, want_counts)) and want_counts


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [("a b", "en", "s")]) == []


@pytest.mark.parametrize("seed", range(4))
def test_transducer_numbers_exactly_its_strings(seed):
    rnd = random.Random(seed)
    strings = sorted({bytes(rnd.choice(b"ab\xc3z") for _ in range(rnd.randint(1, 6))) for _ in range(200)})
    machine = transducer.unpacked(transducer.packed(transducer.build(strings, 1000)))
    asked = strings + [s + b"a" for s in strings] + [s[:-1] for s in strings if len(s) > 1] + [b"q"]
    data = np.frombuffer(b" ".join(asked), np.uint8)
    starts, ends = dv.stretches(data)
    number = {s: 1000 + i for i, s in enumerate(strings)}
    got = machine.numbers(data, starts, ends, (machine.root, machine.first))
    assert sorted(got.tolist()) == sorted(number[s] for s in asked if s in number)
    for i in range(len(asked)):
        one = machine.numbers(data, starts[i : i + 1], ends[i : i + 1], (machine.root, machine.first)).tolist()
        assert one == ([number[asked[i]]] if asked[i] in number else [])


def test_transducer_is_minimal():
    """As many states as there are different sets of continuations."""
    strings = sorted({bytes(x) + y for x in (b"un", b"re", b"in", b"x") for y in (b"do", b"doing", b"tied", b"")} - {b""})
    machine = transducer.build(strings)
    prefixes = {s[:i] for s in strings for i in range(len(s) + 1)}
    futures = {frozenset(s[len(p) :] for s in strings if s.startswith(p)) for p in prefixes}
    assert len(machine.final) == len(futures)


def test_pieces_hold_all_terms():
    texts = [b"One two-three", b"", b"x" * 100, b" ".join(b"ab%c" % c for c in b"abcdefgh") * 9]
    whole = b" ".join(t.translate(dv.TO_TERMS) for t in texts).split()
    for size in (1, 7, 64, 10_000):
        assert [w for p in dv.pieces(texts, size) for w in p.split()] == whole
