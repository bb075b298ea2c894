from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from requestmarts.llm import tokens
from tests.llm.helpers import awkward, documents, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_counts(texts):
    library = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_librarys_on_awkward_rows(spark):
    given = awkward() + [(20, "<|endoftext|>a<|startoftext|> <|endoftext|"), (21, "it's we'Re ÉA 1234 ½ ...")]
    found = rows(tokens.count_tokens(documents(spark, given), PATH, limit=3))
    assert len(found) == len(given)
    expected = library_counts([t or "" for _, t in given])
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == sorted(
        (i or -1, len((t or "").encode()), n, n > 3) for (i, t), n in zip(given, expected, strict=True)
    )


def test_counts_equal_the_librarys_on_random_characters():
    rnd = random.Random(5)
    pools = ["abcdefghij <|>'", "éàüßñ ÉÀǗ̈", "\x00\x1c\x1f\x85  　\t\n\r\x0b ab", "中文字 1²½٣"]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(chr(c) for c in range(a, a + 97) if not 0xD800 <= c < 0xE000) for a in range(1, 0x3000, 97)]
    own = tokens.PairCounter(PATH)
    assert [own.of_text(t) for t in texts] == library_counts(texts)


def test_merges_take_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert tokens.merges_made(list("abc"), ranks) == 2
    assert tokens.merges_made(list("ab"), ranks) == 1
    assert tokens.merges_made([], ranks) == 0


def test_whole_table_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = library_counts([r.text for r in docs.orderBy("doc_id").collect()])
    found = tokens.count_tokens(docs, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in found] == expected


def test_empty_table(spark):
    assert rows(tokens.count_tokens(documents(spark, []), PATH)) == []
