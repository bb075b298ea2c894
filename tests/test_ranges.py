"""Ranges of many rows, for several sort columns at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from requestmarts.operators.ranges import ID, Splits, placed, sample, splits_of
from requestmarts.plans import rank_index

KINDS = {"name": "string", "opened": "timestamp_ntz", "late": "boolean", ID: "string"}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    values = {
        "name": ["a", "b", "é", "Z", None],
        "opened": [f"2024-01-0{d} 10:00:00.5" for d in range(1, 6)] + [None],
        "late": ["true", "false", None],
        ID: [*map(str, range(40)), None],
    }
    data = [tuple(rnd.choice(v) for v in values.values()) for _ in range(400)]
    text = spark.createDataFrame(data, ", ".join(f"{c} string" for c in values))
    return text.select(*(F.col(c).cast(kind) for c, kind in KINDS.items())).localCheckpoint()


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_all_columns_at_once_are_placed_as_each_alone(rows, descending, apart):
    if descending and apart:
        pytest.skip("the rank index ascends")
    sampled, _ = sample(rows, list(KINDS), 200)
    splits = [splits_of(sampled, c, kind, descending, most=m, apart=apart) for (c, kind), m in zip(KINDS.items(), (31, 32, 5, 33), strict=True)]
    splits.append(Splits("name", "string", descending, ()))
    got = placed(rows, splits, "name").groupBy("name", "of", "place").count()
    alone = [rows.select("name", F.lit(i).alias("of"), s.place().alias("place")) for i, s in enumerate(splits)]
    want = alone[0]
    for part in alone[1:]:
        want = want.unionByName(part)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.groupBy("name", "of", "place").count().collect()))


def test_rows_of_the_rank_index_are_placed_without_an_interpreted_loop(spark):
    from requestmarts.schema import SORTABLE_COLUMNS, STORED_DETAIL_SCHEMA

    detail = spark.createDataFrame([], STORED_DETAIL_SCHEMA)
    kinds = dict(detail.dtypes)
    splits = [Splits(c, kinds[c], False, ((None, ""),)) for c in SORTABLE_COLUMNS]
    plan = rank_index.counted(detail, splits)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.lower() and "aggregate(" not in plan.lower()


def test_ranges_of_one_direction_only(rows):
    with pytest.raises(ValueError):
        placed(rows, [Splits("name", "string", False, ()), Splits("name", "string", True, ())])
