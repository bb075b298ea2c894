"""What a build stores for its readers: the rank index of lists and the cubes of dashboards."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from requestmarts.operators.filters import RequestFilter
from requestmarts.operators.ranges import ID, Splits, sample, splits_of
from requestmarts.plans import cubes, listing, rank_index
from requestmarts.plans.dashboard import collected, dashboard, served_dashboard
from requestmarts.schema import SORTABLE_COLUMNS
from requestmarts.sources import readers, standin
from tests import helpers as H


@pytest.fixture(scope="module")
def build(spark, sf_dir):
    return entry._build(entry.tables(spark, sf_dir))


@pytest.fixture(scope="module")
def detail(spark, build):
    return readers.read_mart(spark, readers.DETAIL, build)


def list_order(rows, column, descending):
    """NULLs last both ways; ids, NULL ones last, within equal values."""
    by_id = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1], reverse=descending) + [r for r in rows if r[1] is None]
    some = sorted((r for r in by_id if r[0] is not None), key=lambda r: r[0], reverse=descending)
    return some + [r for r in by_id if r[0] is None]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "boolean"])
def test_ranges_follow_the_list_with_nulls_and_ties(spark, kind, descending):
    rnd = random.Random(f"{kind}{descending}")
    values = {"string": ["a", "b", "é", "Z", None], "timestamp_ntz": [f"2024-01-0{d} 10:00:00" for d in range(1, 6)] + [None], "boolean": ["true", "false", None]}
    data = [(rnd.choice(values[kind]), rnd.choice([*map(str, range(30)), None])) for _ in range(300)]
    df = spark.createDataFrame(data, f"v string, {ID} string").select(F.col("v").cast(kind), ID)
    sampled, n = sample(df.where(F.xxhash64("v", ID) % 3 == 0), ["v"], 1000)
    assert n == len(sampled)
    splits = splits_of(sampled, "v", kind, descending, most=20)
    ordered = list_order([tuple(r) for r in df.collect()], "v", descending)
    place = {}
    reached = 0
    keys = [(None if v is None else df.sparkSession.sql(f"select cast('{v}' as {kind})").first()[0], i) for v, i in splits.keys]
    for row in ordered:
        while reached < len(keys) and list_order([keys[reached], row], "v", descending)[0] == keys[reached]:
            reached += 1
        place[row] = reached
    got = {tuple(r)[:2]: r["place"] for r in df.select("v", ID, splits.place().alias("place")).collect()}
    assert got == place and len(set(got.values())) > 10
    for first, last in ((0, 3), (2, 2), (5, len(keys)), (0, len(keys))):
        inside = {tuple(r) for r in df.where(splits.between(first, last)).collect()}
        assert inside == {r for r, p in place.items() if first <= p <= last}


def test_no_splits_is_one_range(spark):
    df = H.detail(spark, [{}, {}])
    empty = Splits("tipo", "string", False, ())
    assert {r[0] for r in df.select(empty.place()).collect()} == {0}
    assert df.where(empty.between(0, 0)).count() == 2
    assert sample(df.where("id_chamado = '9'"), ["tipo"], 5) == ([], 0)
    assert sample(df.limit(0), ["tipo"], 5) == ([], 0)


def ids(df):
    return [r["id_chamado"] for r in df.collect()]


@pytest.mark.parametrize("sort_order", ["asc", "desc"])
@pytest.mark.parametrize("sort_by", SORTABLE_COLUMNS)
def test_pages_of_the_index_are_pages_of_the_list(spark, build, detail, sort_by, sort_order):
    months = RequestFilter(data_inicio_from="1998-02-01", data_inicio_to=dt.date(2000, 2, 29))
    # Both filters with both directions, in turn over the sort columns.
    filt = months if (SORTABLE_COLUMNS.index(sort_by) + (sort_order == "asc")) % 2 else RequestFilter()
    want = ids(listing.export_rows(detail, filt, sort_by, sort_order))
    last = -(-len(want) // 100)
    for page in (last // 2, last + 5):
        got = ids(listing.served_page(spark, filt, page, 100, sort_by, sort_order, build=build, direct_rows=150))
        at = (min(page, last) - 1) * 100
        assert got == want[at : at + 100]


def test_a_middle_page_reads_one_range_of_its_months(spark, build, detail):
    page = listing.served_page(spark, RequestFilter(), 30, 100, build=build)
    assert page._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = rank_index.locate(spark, build, RequestFilter(), "data_inicio", True, 30, 100)
    assert found.rows_in_ranges < 0.05 * found.total == 0.05 * detail.count()
    assert detail.where(found.predicate).count() == found.rows_in_ranges
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [mes_inicio" in text and "LessThanOrEqual(data_inicio" in text


def test_other_filters_and_empty_lists_need_no_index(spark, build, detail):
    filt = RequestFilter(secretaria="SME", data_inicio_from="1998-02-03")
    assert not rank_index.whole_months(filt)
    want = ids(listing.export_rows(detail, filt, "tipo", "asc"))[200:300]
    assert ids(listing.served_page(spark, filt, 3, 100, "tipo", "asc", build=build, direct_rows=150)) == want
    nothing = RequestFilter(data_inicio_from="2030-01-01")
    assert rank_index.whole_months(nothing)
    assert ids(listing.served_page(spark, nothing, 3, 100, build=build)) == []


@pytest.mark.parametrize(
    "first, last, months, days",
    [
        (None, None, (None, None), []),
        ("2024-01-01", "2024-02-29", ("2024-01-01", "2024-02-29"), []),
        ("2024-01-02", "2024-02-28", None, [("2024-01-02", "2024-01-31"), ("2024-02-01", "2024-02-28")]),
        ("2024-01-02", "2024-04-10", ("2024-02-01", "2024-03-31"), [("2024-01-02", "2024-01-31"), ("2024-04-01", "2024-04-10")]),
        ("2024-01-05", "2024-01-20", None, [("2024-01-05", "2024-01-20")]),
        ("2024-01-01", "2024-01-20", None, [("2024-01-01", "2024-01-20")]),
        ("2024-01-05", None, ("2024-02-01", None), [("2024-01-05", "2024-01-31")]),
        (None, "2023-12-30", (None, "2023-11-30"), [("2023-12-01", "2023-12-30")]),
    ],
)
def test_dates_split_into_months_and_days(first, last, months, days):
    whole, parts = cubes.split_by_month(RequestFilter(data_inicio_from=first, data_inicio_to=last))
    text = lambda f: tuple(None if d is None else str(d) for d in (f.data_inicio_from, f.data_inicio_to))
    assert (whole and text(whole)) == months and [text(p) for p in parts] == days


FILTERS = {
    "department": (RequestFilter(secretaria="SMS"), "rollup"),
    "blank search": (RequestFilter(q="  "), "rollup"),
    "type": (RequestFilter(tipo="HOUSEHOLD-1", subtipo="1-URGENT"), "cube_type"),
    "state and months": (RequestFilter(status="Pendente", data_inicio_from="1998-01-01"), "cube_state_month"),
    "days": (RequestFilter(secretaria="SME", data_inicio_from="1998-01-10", data_inicio_to="1999-05-20"), "cube_month"),
    "days of one month": (RequestFilter(tipo="BUILDING-1", data_inicio_from="1998-01-10", data_inicio_to="1998-01-20"), "cube_type_month"),
    "all columns": (RequestFilter(tipo="BUILDING-1", situacao="Encerrado", data_inicio_to="1999-05-31"), "cube_all"),
    "no such value": (RequestFilter(tipo="nada"), "cube_type"),
    "dates the wrong way round": (RequestFilter(data_inicio_from="1999-05-20", data_inicio_to="1998-01-01"), "cube_month"),
    "text": (RequestFilter(q="urgent", secretaria="SMS"), None),
}


@pytest.mark.parametrize("name", FILTERS)
def test_cubes_answer_as_the_fact_does(spark, build, detail, name):
    filt, cube = FILTERS[name]
    answer = cubes.match(spark, build, filt)
    assert (answer and answer.name) == cube
    # Another date than the build's: ages are carried forward.
    for as_of in (standin.AS_OF, "2003-07-05"):
        served = collected(served_dashboard(spark, filt, as_of=as_of, build=build))
        assert served == collected(dashboard(detail, filt, as_of=as_of))


def test_whole_months_never_read_the_fact(spark, build, detail):
    for filt in (RequestFilter(secretaria="SMS"), RequestFilter(tipo="HOUSEHOLD-1", data_inicio_from="1998-01-01")):
        answer = cubes.match(spark, build, filt)
        assert not answer.days
        read = cubes.rolled_up(spark, build, answer, detail, standin.AS_OF).inputFiles()
        assert read and all(f"/{answer.name}/" in f for f in read)


def test_answers_leave_nothing_in_executor_storage(spark, build, detail):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    collected(served_dashboard(spark, RequestFilter(secretaria="SMS"), as_of=standin.AS_OF, build=build))
    collected(dashboard(detail, RequestFilter(secretaria="SMS"), as_of=standin.AS_OF))
    entry.queries()["late_regions_with_units"](spark, "/root/testdata/sf0.01").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_build_leaves_an_earlier_lookup_alone(spark, sf_dir, build):
    """Each lookup owns its grid: plans of an earlier one shuffle nothing after a build."""
    from tests.test_plans import operators

    nodes = operators(entry.tables(spark, sf_dir).detail)
    assert not [n for n in nodes if n.startswith("Exchange")]
