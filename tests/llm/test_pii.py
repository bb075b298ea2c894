from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from requestmarts.llm import pii
from requestmarts.llm.queries import op1_skip_chain_field
from tests.llm.helpers import awkward, documents, rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def right(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if right(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def check(row, text):
    want = brute(text)
    assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
    every = row["spans"].split(",") if row["spans"] else []
    assert [s for s in every if s in want] == want
    assert len(every) == len(want) + row["n_added"]
    starts = [int(s.split(":")[1]) for s in every]
    assert starts == sorted(starts)


def test_base_spans_equal_the_patterns_on_random_text():
    rnd = random.Random(2)
    pools = ["0123456789", "a.@-_%+", " ().-+", "Ab é@.1"]
    for _ in range(4000):
        text = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 50)))
        assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == brute(text)
    card = "4111 1111 1111 1111 and 4111-1111-1111-1112 x@y.zz@a.b.c. 1.2.3.4.5.6.7.8 300.1.1.1 001.0255.3.4 +1 (234) 567-8901"
    assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(card)] == brute(card)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 60_000, "1." * 60_000, "+1" + " (" * 60_000, "=" * 100_000):
        pii.base_spans(text)


def test_awkward_rows(spark):
    given = awkward() + [(70, "mail a.b@c.org, ip 10.0.0.1; +1 (234) 567-8901")]
    found = rows(pii.find_personal_data(documents(spark, given)))
    assert len(found) == len(given)
    texts = dict(x for x in given if x[0] not in (4, None))
    for row in found:
        if row["doc_id"] in texts:
            check(row, texts[row["doc_id"]])
        else:
            assert row["spans"] == ""


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = rows(op1_skip_chain_field(spark, sf_dir))
    assert len(found) == len(docs)
    for row in found:
        check(row, docs[row["doc_id"]])
    assert sum(r["n_added"] for r in found) > 0


def test_a_clear_place_labels_a_distant_repeat(spark, sf_dir):
    field = pii.learned_field(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    filler = " word" * 400
    alone = f"{filler} 7f3a9c21bb {filler}"
    linked = f"password=7f3a9c21bb {filler} 7f3a9c21bb {filler}"
    assert not pii.added_spans(alone, [], field)
    spans = pii.added_spans(linked, pii.base_spans(linked), field)
    assert len(spans) == 2 and {s[2] for s in spans} == {"secret"}


def test_secrets_of_letters_alone_and_all_their_repeats_are_spans(spark, sf_dir):
    field = pii.learned_field(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    filler = " word" * 300 + " "
    for told, value, again in (
        ("password=swordfish", "swordfish", ["swordfish", "Sword-fish,"]),
        ("api_key = abcdefghij", "abcdefghij", ["(abcdefghij)"]),
        ("password: hunterxyz", "hunterxyz", ["hunterxyz"] * 30),
        ('{"token":"abcdefgh"}', "abcdefgh", ["abcdefgh abcdefgh abcdefgh."]),
        ("db_password=abc=def==", "abc=def", ["abc=def"]),
    ):
        places = [filler.join(["", again[0], told, *again[1:], ""]), filler.join([told, *again])]
        for text in places:
            found = pii.added_spans(text, [], field)
            plain = [text[a:b].replace("-", "").lower() for a, b, _ in found]
            times = 1 + sum(x.replace("-", "").lower().count(value) for x in again)
            assert plain == [value] * times and {k for _, _, k in found} == {"secret"}
    assert not pii.added_spans(f"the secret agent met {filler} an agent", [], field)
    assert not pii.added_spans(f"swordfish {filler} swordfish", [], field)


def test_neighbouring_pieces_of_a_number_are_one_span(spark, sf_dir):
    def pieces(text, kind, tokens):
        places, at = {}, 0
        for i, token in enumerate(tokens):
            at = text.index(token, at)
            places[i] = (at, at + len(token), kind)
            at += len(token)
        chain = {i: i - 1 for i in places if i and len(text[places[i - 1][1] : places[i][0]].strip(" ()")) == 0}
        return [text[a:b] for a, b, _ in pii.numbers_of_pieces(text, places, chain)]

    two = "+1 (826) 555-4081 +1 (843) 555-7672"
    assert pieces(two, "phone", ["+1", "826", "555-4081", "+1", "843", "555-7672"]) == ["+1 (826) 555-4081", "+1 (843) 555-7672"]
    assert pieces("555-4081 555-4081", "phone", ["555-4081"] * 2) == ["555-4081", "555-4081"]
    assert pieces("1234 5678 9012 3456 7890 1", "card", ["1234", "5678", "9012", "3456", "7890", "1"]) == ["1234 5678 9012 3456", "7890 1"]
    assert pieces("7536784127813050 4845168114407329", "card", ["7536784127813050", "4845168114407329"]) == ["7536784127813050", "4845168114407329"]
    assert pieces("12 apples 34", "phone", ["12", "34"]) == ["12", "34"]
    for kind in ("email", "ip", "secret"):
        assert pieces("a1 b2", kind, ["a1", "b2"]) == ["a1", "b2"]
    assert pii.numbers_of_pieces("", {}, {}) == []
    field = pii.learned_field(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for text in ("some words +1 (826) 555-4081 190.137.223.204 some", "of +1 (843) 555-7672 170.106.47.218 Et, of"):
        found = pii.added_spans(text, pii.base_spans(text), field)
        assert [(text[a:b], k) for a, b, k in found] == [(text[text.index("+") : text.index(" 1", text.index("-"))], "phone")]


def planted(texts):
    """(text, places) with a secret that is assigned once and stands alone elsewhere; every
    third text has its tokens alone, which makes them no secret."""
    rnd = random.Random(9)
    letters, mixed = "abcdefghjkmnpqrstuvwxyz", "abcdef0123456789"
    for i, text in enumerate(texts):
        value = "".join(rnd.choice((letters, mixed)[i % 2]) for _ in range(rnd.randint(9, 16)))
        words = text.split(" ")
        spots = sorted(rnd.sample(range(len(words)), min(3, len(words))))
        told = "" if i % 3 == 2 else rnd.choice(["password=", "api_key: ", "token = "])
        home = rnd.randrange(len(spots))
        for n, spot in enumerate(spots):
            words[spot] = (told if n == home else "") + value
        new = " ".join(words)
        places = {m.span() for m in re.finditer(rf"(?<!\S){value}(?!\S)", new) if not told or new[: m.start()][-len(told) :] != told}
        yield new, places if told else set(), value


def precision_and_recall(texts, field):
    """Of the spans that the field adds to those of assigned values and base patterns."""
    right = wrong = missed = 0
    for text, places, value in planted(texts):
        assigned = set(pii.assigned_values(text))
        spans = {(a, b) for a, b, _ in pii.added_spans(text, pii.base_spans(text), field)} - assigned
        spans = {(a, b) for a, b in spans if text[a:b] == value}
        right += len(spans & places)
        wrong += len(spans - places)
        missed += len(places - spans)
    return right / max(1, right + wrong), right / max(1, right + missed)


def test_the_links_find_planted_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = pii.learned_field(docs)
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text and 20 <= len(r.text.split(" ")) <= 2000]
    linked = precision_and_recall(texts, field)
    field.weights[pii.REPEATS] = 0  # what the links do by themselves
    links_alone = precision_and_recall(texts, field)
    field.skip[:] = 0
    neither = precision_and_recall(texts, field)
    print(len(texts), linked, links_alone, neither)
    assert min(linked) >= 0.95
    assert links_alone[1] > neither[1]


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    features = rng.integers(0, 2, (4, pii.FEATURES)).astype(np.float32)
    nodes = pii.Nodes([(0, 1)] * 4, np.array([-1, 2, -1, -1]), features, np.array([[0, 1], [1, 2]]), np.array([[0, 3]]))
    unary = features @ field.weights
    want = np.zeros((4, k))
    for labels in np.ndindex(*(k,) * 4):
        if labels[1] != 2:
            continue
        a, b, c, d = labels
        score = unary[0, a] + unary[2, c] + unary[3, d] + field.chain[a, b] + field.chain[b, c] + field.skip[a, d]
        want[range(4), labels] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii.beliefs(field, nodes, rounds=80), want, atol=1e-6)


def test_empty_table(spark):
    assert rows(pii.find_personal_data(documents(spark, []))) == []
