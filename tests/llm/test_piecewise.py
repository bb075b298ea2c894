from __future__ import annotations

import hashlib
import random

import pytest
import xxhash

from requestmarts.llm import piecewise as pw
from tests.llm.helpers import awkward, documents, rows


def plain_fingerprint(text: bytes) -> str:
    """Byte by byte, all levels tried one after another."""

    def level_at(i):
        if i < 6:
            return 0
        h = 0
        for b in text[i - 6 : i + 1]:
            h = (h + b + 1) * 0x9E3779B1 % 2**32
        h ^= h >> 15
        return 32 - (h * 0x85EBCA77 % 2**32).bit_length()

    levels = [level_at(i) for i in range(len(text))]

    def signature(level):
        out, piece = "", b""
        for i in range(len(text)):
            piece += text[i : i + 1]
            if levels[i] >= level or i == len(text) - 1:
                out += pw.ALPHABET[xxhash.xxh32_intdigest(piece) % 64]
                piece = b""
        return out

    level = 1
    while sum(x >= level for x in levels) >= 64:
        level += 1
    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def plain_likeness(a, b):
    at = []
    for x in (a, b):
        level, one, two = x.split(":")
        at.append({int(level): one, int(level) + 1: two})
    common = set(at[0]) & set(at[1])
    longest = sum(max(len(at[0][k]), len(at[1][k])) for k in common)
    if not common:
        return 0.0
    return 1.0 - sum(plain_distance(at[0][k], at[1][k]) for k in common) / longest if longest else 1.0


def brute(docs):
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, int_hash(d[1] or "")))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        prints = [plain_fingerprint(t.encode()) for t in (text, new, after)]
        out.append(
            (i, len(text), hashlib.sha256(new.encode()).hexdigest(), prints[0], prints[1],
             plain_likeness(prints[0], prints[1]), plain_likeness(prints[0], prints[2]))
        )
    return sorted(out, key=str)


def int_hash(text):
    return xxhash.xxh64(text.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(text.encode(), seed=42).intdigest() >> 63)


def found(spark, docs):
    return sorted((tuple(r.values()) for r in rows(pw.compare_with_next(documents(spark, docs)))), key=str)


def test_equals_brute_force_with_nulls_repeats_and_long_texts(spark):
    rnd = random.Random(8)
    words = ["alpha", "béta", "γ", "x1", "The", "\n", "𝔘nicode"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 3, 20, 100, 600]))) for i in rnd.sample(range(500), 60)]
    docs += [d for d in awkward() if d[0] not in (5, 6)] + [(5, "ab" * 9000), (600, "z" * 70_000), (601, None), (602, docs[0][1])]
    assert found(spark, docs) == brute(docs)


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_the_last_document_is_followed_by_the_first_whatever_the_ranges(spark, partitions):
    docs = [(i, f"{i} " * (i % 7 + 5)) for i in range(35)] + [(3, "again"), (3, "again"), (None, "no id"), (None, "no id"), (None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(spark, docs) == brute(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table_and_single_document(spark):
    assert found(spark, []) == []
    [row] = found(spark, [(7, "abcdefgh" * 4)])
    assert row[0] == 7 and row[6] == 1.0


def test_edit_distance_equals_the_table():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 5, 63, 64]))) for _ in range(2))
        assert pw.edit_distance(a, b) == plain_distance(a, b)


def test_pieces_join_to_the_text_and_segments_do_not_show(monkeypatch):
    text = random.Random(4).randbytes(5000)
    levels = pw.cut_levels(text)
    assert all(b"".join(pw.pieces(text, levels, k)) == text for k in (1, 4, 9, 33))
    whole = pw.fingerprint(text)
    monkeypatch.setattr(pw, "SEGMENT", 37)
    assert pw.fingerprint(text) == whole == plain_fingerprint(text)


def test_an_edit_stays_local_and_other_texts_are_far(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows(pw.compare_with_next(docs))
    assert len(got) == docs.count()
    long = [r for r in got if r["n_chars"] >= 200]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.6
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.97 * len(long)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
