"""What a build stores for filter options and text search."""

from __future__ import annotations

import datetime as dt

import pytest

import __spark_entry__ as entry
from requestmarts.operators.filters import RequestFilter, in_months
from requestmarts.plans import listing, search_index
from requestmarts.plans.dashboard import collected, dashboard, served_dashboard
from requestmarts.schema import FILTER_COLUMNS, OPENED_MONTH
from requestmarts.sources import readers, standin
from tests import helpers as H

# (request, opened, type, status): ids of digits, of letters, with signs, too short, NULL; a NULL date.
REQUESTS = [
    {"id_chamado": "10012", "data_inicio": "2024-01-01 00:00:00", "tipo": "Vacina", "status": "Pendente"},
    {"id_chamado": "RIO-77%", "data_inicio": "2024-01-31 23:59:59", "tipo": "Creche", "status": "Fechado"},
    {"id_chamado": "a\\b_c", "data_inicio": "2024-02-10 10:00:00", "tipo": "Poda É", "status": None},
    {"id_chamado": "7", "data_inicio": "2024-02-29 10:00:00", "tipo": None, "status": "Pendente"},
    {"id_chamado": None, "data_inicio": "2024-03-05 10:00:00", "tipo": "Vacina", "status": "Fechado"},
    {"id_chamado": "İSTANBUL", "data_inicio": None, "tipo": "Creche", "status": "Pendente"},
    {"id_chamado": "10099", "data_inicio": "2024-04-05 10:00:00", "tipo": "Vacina", "status": "Fechado", "secretaria": "Outros"},
]
TEXTS = ["100", "rio-77", "%77%", "o_7", "\\b", "istanbul", "İST", "é", "vac%na", "pend", "xyz", "7", "  ", "cre he", "001%2", "1__12"]
DATES = [(None, None), ("2024-01-01", "2024-01-30"), ("2024-01-31", None), (None, dt.date(2024, 2, 10)), ("2024-02-11", "2024-02-28"), ("2024-01-15", "2024-03-05"), ("2024-03-01", "2024-02-01")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A build folder with the fact and its search tables, and the fact."""
    folder = str(tmp_path_factory.mktemp("build"))
    detail = H.detail(spark, REQUESTS).selectExpr("*", f"trunc(data_inicio, 'month') as {OPENED_MONTH}")
    detail.write.partitionBy(OPENED_MONTH).parquet(f"{folder}/{readers.DETAIL}")
    stored = readers.read_mart(spark, readers.DETAIL, folder)
    search_index.dictionary(stored).write.parquet(f"{folder}/{search_index.DICTIONARY}")
    search_index.id_pieces(stored).write.parquet(f"{folder}/{search_index.ID_PIECES}")
    return folder, stored


@pytest.mark.parametrize("text", TEXTS)
def test_search_of_a_build_equals_the_scan(spark, small, text):
    folder, detail = small
    for first, last in ((None, None), ("2024-01-02", "2024-02-28")):
        filt = RequestFilter(q=text, data_inicio_from=first, data_inicio_to=last)
        assert H.rows_of(search_index.served_rows(spark, folder, filt)) == H.rows_of(filt.apply(detail))
        assert H.rows_of(listing.served_options(spark, filt, build=folder)) == H.rows_of(listing.filter_options(detail, filt))


@pytest.mark.parametrize("first, last", DATES)
def test_options_of_a_build_equal_the_scan(spark, small, first, last):
    folder, detail = small
    for more in ({}, {"tipo": "Vacina"}, {"status": "Fechado", "secretaria": "SMS"}, {"tipo": "nada"}):
        filt = RequestFilter(data_inicio_from=first, data_inicio_to=last, **more)
        assert H.rows_of(listing.served_options(spark, filt, build=folder)) == H.rows_of(listing.filter_options(detail, filt))
    for column in (*FILTER_COLUMNS, "longitude"):
        got = listing.served_values(spark, column, filt, build=folder)
        assert got.collect() == listing.distinct_values(detail, column, filt).collect()


def test_pieces_leave_out_wildcards(spark):
    assert search_index.pieces_of(spark, "ABCD%ef_Ghi") == {"abc", "bcd", "ghi"}
    assert search_index.pieces_of(spark, "ab%c_") == set()


def test_months_are_those_in_which_all_pieces_occur(spark, small):
    folder, _ = small
    months = search_index.months_of_ids
    assert months(spark, folder, "rio-77") == {dt.date(2024, 1, 1)}
    assert months(spark, folder, "stan") == {None}
    assert months(spark, folder, "100%xyz") == set()
    assert months(spark, folder, "77") is None


def test_no_requests_no_matches(spark, tmp_path):
    detail = H.detail(spark, []).selectExpr("*", f"trunc(data_inicio, 'month') as {OPENED_MONTH}")
    for name, df in ((readers.DETAIL, detail), (search_index.DICTIONARY, search_index.dictionary(detail)), (search_index.ID_PIECES, search_index.id_pieces(detail))):
        df.write.parquet(f"{tmp_path}/{name}")
    for filt in (RequestFilter(), RequestFilter(q="abc"), RequestFilter(q="a")):
        assert search_index.served_rows(spark, str(tmp_path), filt).count() == 0
        assert listing.served_options(spark, filt, build=str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def build(spark, sf_dir):
    return entry._build(entry.tables(spark, sf_dir))


def test_column_and_date_options_never_read_the_fact(spark, build):
    for filt in (entry.LISTED, entry.DAYS, entry.SOLVED):
        read = listing.served_options(spark, filt, build=build).inputFiles()
        assert read and all(f"/{search_index.DICTIONARY}/" in f for f in read)


def test_a_search_reads_only_months_that_can_match(spark, build):
    detail = readers.read_mart(spark, readers.DETAIL, build)
    filt = RequestFilter(q="HOUSEHOLD-3", data_inicio_from="1999-12-20", data_inicio_to="2000-01-10")
    plan = search_index.served_rows(spark, build, filt)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and OPENED_MONTH in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert search_index.months_of_ids(spark, build, "HOUSEHOLD-3") == set()
    nothing = search_index.served_rows(spark, build, RequestFilter(q="no such words"))
    assert nothing.inputFiles() == [] and nothing.count() == 0
    assert detail.where(in_months({None})).count() == 0


def test_text_no_id_holds_is_answered_from_the_widest_cube(spark, build):
    detail = readers.read_mart(spark, readers.DETAIL, build)
    for filt in (RequestFilter(q="urgent", secretaria="SMS"), entry.SOLVED, RequestFilter(q="no such words")):
        assert search_index.cube_answer(spark, build, filt).name == "cube_all"
        for as_of in (standin.AS_OF, "2003-07-05"):
            served = collected(served_dashboard(spark, filt, as_of=as_of, build=build))
            assert served == collected(dashboard(detail, filt, as_of=as_of))
    assert search_index.cube_answer(spark, build, entry.NUMBERED) is None
    served = collected(served_dashboard(spark, entry.NUMBERED, as_of=standin.AS_OF, build=build))
    assert served == collected(dashboard(detail, entry.NUMBERED, as_of=standin.AS_OF))
