"""The physical plans the design relies on."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from requestmarts.operators.filters import RequestFilter
from requestmarts.operators.measures import rollup
from requestmarts.operators.territory import geo_pairs
from requestmarts.plans import listing, marts


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return entry.tables(spark, sf_dir)


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("detail") / "detail")
    tables.detail.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df) -> list[str]:
    """Node names of the physical plan; a cached frame counts as one scan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names, cached = [], None
    for line in text.splitlines():
        indent = re.match(r"[ :+-]*(\*\(\d+\) )?", line).end()
        unindented = indent == 0 and names  # rest of a literal with a line break
        if unindented or (cached is not None and indent > cached):
            continue
        cached = indent if line[indent:].startswith("InMemoryRelation") else None
        names.append(line[indent:])
    return names


def test_enrichment_shuffles_nothing(tables):
    nodes = operators(tables.detail)
    assert sum(n.startswith("BroadcastHashJoin") for n in nodes) >= 4
    assert not [n for n in nodes if n.startswith(("Exchange", "SortMergeJoin", "BroadcastNestedLoop", "Cartesian"))]


def test_point_join_is_an_equi_join(tables):
    text = plan(geo_pairs(tables.scoped, tables.lookup))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert re.search(r"BroadcastHashJoin \[level", text)


def test_type_map_join_becomes_inner(tables):
    assert re.search(r"BroadcastHashJoin \[tipo#\d+\], \[tipo#\d+\], Inner", plan(tables.scoped))


def test_first_page_is_a_top_k(stored):
    text = plan(listing.list_page(stored, RequestFilter()))
    assert "TakeOrderedAndProject" in text and "Window" not in text


@pytest.mark.parametrize("build", [marts.worst_territories, marts.complaints, marts.top_territories])
def test_global_rankings_are_top_k(tables, build):
    text = plan(build(tables.m, "subprefeitura"))
    assert "TakeOrderedAndProject" in text and "Window" not in text


def test_ranking_per_department_prunes_early(tables):
    assert plan(marts.late_by_department(tables.m, "subprefeitura")).count("WindowGroupLimit") == 2


def test_date_filter_reaches_the_files(stored):
    filt = RequestFilter(data_inicio_from="2000-01-01", data_inicio_to="2000-01-31", secretaria="SMS")
    text = plan(filt.apply(stored))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(data_inicio,2000-01-01" in pushed
    assert "LessThan(data_inicio,2000-02-01" in pushed
    assert "EqualTo(secretaria,SMS)" in pushed


def test_only_needed_columns_are_read(stored):
    from requestmarts.operators.measures import measured

    text = plan(marts.by_category(measured(stored)))
    assert re.search(r"ReadSchema: struct<categoria:string>", text)


def test_rollup_is_one_scan_with_map_side_sums(stored):
    from requestmarts.operators.measures import measured

    text = plan(rollup(measured(stored)))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert text.index("partial_sum") > text.index("Exchange")
