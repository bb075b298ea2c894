from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from requestmarts.operators import territory, uniqueness
from tests import helpers as H
from tests.test_plans import operators


def frame(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "_hash string, _value int")


def brute(values):
    return sorted(v for v, n in Counter(values).items() if n > 1 and v is not None)


def found(frame, **limit):
    got = uniqueness.repeated_values(frame, "_hash", **limit)
    return [] if got is None else [r[0] for r in H.rows_of(got)]


@pytest.mark.parametrize("limit", [{}, {"max_broadcast_bytes": 0}])
def test_repeated_values_equal_a_count_of_all(spark, limit):
    rnd = random.Random(5)
    many = [rnd.choice([None, "", "é", str(rnd.randint(0, 900))]) for _ in range(2000)]
    for values in ([], [None, None], ["a", "b", None, None], ["a", "a", "a"], ["hot"] * 700 + ["x", "y", "y"], many):
        assert found(frame(spark, values), **limit) == brute(values)


@pytest.mark.parametrize("values", [["a", "b", "c"], ["a", "b", "b", "c"]])
def test_different_values_that_share_a_hash_are_told_apart(spark, monkeypatch, values):
    every = lambda df, column: df.select(F.xxhash64(column).alias("_hash")).distinct()
    monkeypatch.setattr(uniqueness, "repeated_hashes", every)
    assert found(frame(spark, values)) == brute(values)


def test_the_first_pass_moves_hashes_and_no_values(spark):
    nodes = operators(uniqueness.repeated_hashes(frame(spark, ["a", "b"]), "_hash"))
    moved = [n for n in nodes if n.startswith("Exchange")]
    assert len(moved) == 1 and "hashpartitioning(_groupingexpression#" in moved[0]
    assert any(n.startswith("Project") and "xxhash64" in n for n in nodes)
    assert any(n.startswith("HashAggregate") and "keys=[_groupingexpression#" in n and "partial_count" in n for n in nodes)


def test_requests_without_repeats_need_one_pass(spark, monkeypatch):
    def stored(df):
        raise AssertionError("nothing repeats, so nothing is stored")

    monkeypatch.setattr(uniqueness, "checkpointed", stored)
    lookup = territory.territory_lookup(H.areas(spark, [("1", "A", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")]))
    requests = H.requests(spark, [{"id_bairro": "1"}, {"id_chamado": None, "id_bairro": "1"}, {"id_chamado": None}])
    for unique_ids in (True, False):
        rows = H.rows_of(territory.resolve_territory(requests, lookup, unique_ids=unique_ids).select("id_chamado", "subprefeitura"))
        assert rows == [("1", "A"), (None, None), (None, None)]
