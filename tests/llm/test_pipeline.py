from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from requestmarts.llm import langid, mixing
from tests.llm.helpers import awkward, documents, rows
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_sharding import check_law
from tests.llm.test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Rows that went into each stage, and the last one's."""
    folder = tmp_path_factory.mktemp("steps")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(rows(docs))
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return [*out, rows(docs)]


def ids(stage):
    return sorted(r["doc_id"] for r in stage)


def test_language_stage_keeps_recognised_documents(spark, sf_dir, steps):
    """Those that are in the language the network finds; noise of the same letters is in none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.train(langid.training_rows(docs))
    recognised = langid.recognised(net, [r["text"] for r in steps[0]])
    assert ids(steps[1]) == sorted(r["doc_id"] for r, known in zip(steps[0], recognised, strict=True) if known)
    assert len(steps[1]) >= 0.99 * len(steps[0])
    noise = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for i in range(20)]
    assert sum(langid.recognised(net, noise)) <= 2 and not any(langid.recognised(net, [None, "", "12 34"]))


def test_near_duplicate_stage_equals_brute_force(steps):
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in steps[1]]
    assert ids(steps[2]) == sorted(set(brute_components(pairs)))


def test_decontamination_stage_equals_brute_force(spark, sf_dir, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in steps[2] if not brute_contamination(r["text"], items)[4]]
    assert ids(steps[3]) == sorted(clean) and len(clean) < len(steps[2])


def test_mixing_stage_keeps_the_sampled(spark, steps):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in steps[3]], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(docs, percent=corpus_pipeline.MIX_PERCENT, max_epochs=1)
    assert ids(steps[4]) == sorted(r["doc_id"] for r in rows(mixed) if r["copies"])
    assert len(steps[4]) >= 0.7 * len(steps[3])


def test_columns_and_shards(steps):
    assert all(set(s[0]) == {"doc_id", "text", "lang", "source", "n_chars"} for s in steps[:5])
    check_law(steps[5])
    assert ids(steps[5]) == ids(steps[4])


def test_run_applies_all_stages(spark, sf_dir, steps):
    assert sorted(map(str, rows(corpus_pipeline.run(spark, sf_dir)))) == sorted(map(str, steps[5]))


def test_repeated_and_null_rows_are_sampled_as_often_as_their_copies(spark):
    docs = documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "e f"), (None, None), (2, "g h i"), (3, "j k")])
    for percent, epochs in ((60, 1), (150, 2), (300, 3)):
        mixed = rows(mixing.mix(docs, {}, percent, epochs))
        want = Counter()
        for r in mixed:
            want[r["doc_id"]] += r["copies"]
        found = mixing.sampled_documents(docs, {}, percent, epochs)
        assert found.columns == docs.columns
        assert Counter(r["doc_id"] for r in rows(found)) == +want


@pytest.mark.parametrize("given", [[], "awkward"])
def test_stages_take_awkward_rows_and_keep_all_columns(spark, sf_dir, tmp_path, given):
    text = "The of and with that this is a sentence of some words number {}"
    rows_in = awkward() + [(80 + i, text.format(i // 2)) for i in range(6)] if given else []
    docs = documents(spark, rows_in)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert docs.columns == columns
            assert all((r["doc_id"], r["text"]) in set(rows_in) for r in rows(docs))
    check_law(rows(docs))
    assert bool(rows_in) == bool(rows(docs))


CLASHING = ("_n", "_id", "_root", "_leaf", "_text", "_digest", "_rows", "_language_of_row", "row", "root", "key", "fp", "found", "leaf", "n_tokens", "domain")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_further_column_and_return_it(spark, sf_dir, name):
    """Columns named like the stages' own are carried along with their values."""
    text = "The of and with that this is a sentence of some words number {}"
    docs = documents(spark, [(i, text.format(i // 2)) for i in range(12)])
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    if name == "sharding":
        check_law(rows(out))
        return
    assert out.columns == docs.columns
    found = rows(out)
    assert found and all(r[c] == f"{c} {r['doc_id']}" for r in found for c in CLASHING)


def test_near_duplicates_and_decontamination_take_null_texts(spark, sf_dir):
    docs = documents(spark, awkward())
    kept = rows(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    assert sum(r["text"] is None or not r["text"].strip() for r in kept) == 1
    assert len(rows(corpus_pipeline.decontamination(spark, docs, sf_dir))) == len(awkward())
    assert corpus_pipeline.mixture(spark, docs, sf_dir).columns == docs.columns
