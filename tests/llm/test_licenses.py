from __future__ import annotations

import re

from requestmarts.llm import licenses
from requestmarts.llm.queries import op7_short_notices
from tests.llm.helpers import awkward, documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def base(row):
    return tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_base_equals_brute_force_on_awkward_rows(spark):
    given = awkward() + [(30, "mit license mit license"), (31, "CC-BY cc by-sa; Apache\nLicense"), (32, "mitlicense")]
    found = rows(licenses.scan_licenses(documents(spark, given)))
    order = lambda x: str(x)
    assert sorted(((r["doc_id"], *base(r)) for r in found), key=order) == sorted(
        ((i, *brute(t)) for i, t in given), key=order
    )


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = rows(op7_short_notices(spark, sf_dir))
    assert len(found) == len(docs)
    assert all(base(r) == brute(docs[r["doc_id"]]) for r in found)
    assert any("notice" in r["labels"] for r in found)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_notices_within_the_bound_are_found_with_their_edits(spark):
    text = "so: Permission is herebby granted, free of chrge, to any persn ... and x. Redistrbution and use in sorce and binary forms"
    [row] = rows(licenses.scan_licenses(documents(spark, [text])))
    assert row["labels"] == "notice-bsd,notice-mit"
    assert 0 < row["score"] < 1
    for span in row["notices"]:
        notice = next(n for n, label in licenses.NOTICES.items() if label == span["label"] and edits(span["matched"], n) == span["edits"])
        assert span["edits"] <= len(notice) // licenses.CHARACTERS_PER_EDIT
    assert row["notices"][0]["first_word"] == 1
    assert row["notices"][0]["last_word"] == 10


def test_every_copy_of_a_repeated_notice_is_found(spark):
    good, bad = "licensed under the apache license version 2 0", "licensed under the apache lisense version 2 0"
    texts = [[bad] * 20 + [good], [bad, good] * 5, [good, bad, bad], [bad] * 3000 + [good]]
    found = {r["doc_id"]: r["notices"] for r in rows(licenses.scan_licenses(documents(spark, [" ".join(x) for x in texts])))}
    for i, copies in enumerate(texts):
        own = [s for s in found[i] if s["label"] == "notice-apache-2.0"]
        assert [(s["matched"], s["edits"]) for s in own] == [(c, int(c == bad)) for c in copies]
        assert [s["first_word"] for s in own] == [8 * k for k in range(len(copies))]


def test_notices_beyond_the_bound_are_not_found(spark):
    [row] = rows(licenses.scan_licenses(documents(spark, ["permission is granted to some persons of charge"])))
    assert row["labels"] == "" and row["score"] == 0 and row["notices"] == []
    assert rows(licenses.scan_licenses(documents(spark, []))) == []
