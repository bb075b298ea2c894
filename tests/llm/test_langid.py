from __future__ import annotations

import zlib

import numpy as np
import pytest

from requestmarts.llm import langid
from requestmarts.llm.queries import op8_recurrent_bytes
from tests.llm.helpers import awkward, documents, rows


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    return langid.train(langid.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_gradients_equal_differences():
    net = langid.Network.random(["a", "b", "c"], 4, seed=3)
    for layer in (net.forward, net.backward):
        layer.gates, layer.candidate = layer.gates.astype(float), layer.candidate.astype(float)
    net.out, net.bias, net.embedding = net.out.astype(float), net.bias.astype(float), net.embedding.astype(float)
    data = np.random.default_rng(0).integers(0, 5, (3, 7)).astype(np.uint8)
    given = (data, np.array([7, 5, 2]), np.array([0, 2, 1]))
    _, grads = langid.gradients(net, *given)
    for a, g in zip(net.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        a[at] += 1e-4
        up = langid.gradients(net, *given)[0]
        a[at] -= 2e-4
        down = langid.gradients(net, *given)[0]
        a[at] += 1e-4
        assert g[at] == pytest.approx((up - down) / 2e-4, rel=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    found = {r["doc_id"]: r for r in rows(op8_recurrent_bytes(spark, sf_dir))}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    assert all(found[r.doc_id]["held_out"] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    right = [found[r.doc_id]["lang_pred"] == r.lang for r in docs if found[r.doc_id]["held_out"]]
    assert np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_text_alone_decides_and_batches_do_not_matter(net):
    texts = ["the of and with", "", None, "123 !!", "le de la " * 700, "der und die " * 10]
    together = langid.predictions(net, texts)
    for text, (lang, score) in zip(texts, together, strict=True):
        [(alone, own)] = langid.predictions(net, [text])
        assert alone == lang and own == pytest.approx(score, abs=1e-4)
    assert [x for x, _ in together[1:4]] == ["und"] * 3


def test_awkward_rows(spark, net):
    given = awkward()
    found = rows(langid.identify_languages(documents(spark, given), net))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in given)
    unknown = sorted(str(r["doc_id"]) for r in found if r["lang_pred"] == "und")
    assert unknown == sorted(["1", "2", "3", "9", "None"])


def test_without_labels_nothing_is_learned(spark):
    docs = documents(spark, ["some text"]).drop("lang").selectExpr("*", "cast(null as string) lang")
    [row] = rows(langid.identify_languages(docs))
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert rows(langid.identify_languages(documents(spark, []))) == []


def test_sample_is_bounded_and_leaves_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taught = langid.training_rows(docs, sample=5)
    assert {lang for lang, _ in taught} == {"en", "fr", "de", "es"}
    assert len(taught) <= 4 * 5 * langid.TRAIN_WINDOWS
    held = [r.text.encode() for r in docs.where(langid.held_out("doc_id")).collect()]
    own = [w for _, w in taught if len(w) == langid.WINDOW]
    seen = [r.text.encode() for r in docs.where(~langid.held_out("doc_id")).collect()]
    assert all(any(w in t for t in seen) for w in own) and held


def test_rejected_documents_go(spark, sf_dir, net):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = langid.accepted(docs.unionByName(docs.limit(1).selectExpr("-1L doc_id", "'12 34' text", "lang", "source", "n_chars")), net)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert -1 not in ids and len(ids) >= 0.99 * 1000


def test_shuffled_text_and_unlearned_scripts_go_and_clean_rows_stay(spark, sf_dir, net):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [r.text for r in docs.where(langid.held_out("doc_id") & (docs.text != "")).collect()]
    rng = np.random.default_rng(5)
    shuffled = ["".join(rng.permutation(list(t))) for t in held[:100]]
    cyrillic, greek = (["".join(chr(a + ord(c) % n) if c.isalpha() else c for c in t) for t in held[:100]] for a, n in ((0x430, 32), (0x3B1, 24)))
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)) for _ in range(100)]
    assert np.mean(langid.recognised(net, held)) >= 0.99
    for texts in (shuffled, cyrillic, greek, noise):
        assert np.mean(langid.recognised(net, texts)) <= 0.02
