from __future__ import annotations

import datetime as dt

import pytest

from requestmarts.operators.filters import RequestFilter, sort_column
from requestmarts.plans import listing
from tests import helpers as H


def ids(df):
    return [r["id_chamado"] for r in df.collect()]


def test_active_counts_a_blank_search():
    assert not RequestFilter().active
    assert not RequestFilter(q="", tipo="").active
    assert RequestFilter(q="  ").active
    assert RequestFilter(data_inicio_to="2024-01-01").active


def test_blank_search_filters_nothing(spark):
    df = H.detail(spark, [{}, {"tipo": None}, {"secretaria": "Outros"}])
    assert sorted(ids(RequestFilter(q="  ").apply(df))) == ["1", "2"]


def test_search(spark):
    tipos = ("xaxbx", "xa_bx", "xa\\bx", "50%", "50 e mais", "Posto de Saúde")
    df = H.detail(spark, [{"tipo": t} for t in tipos]).cache()
    expected = {
        "a_b": ["1", "2", "3"],
        "a\\b": ["3"],
        "50%": ["4", "5"],
        "SAÚDE": ["6"],
        "saude": [],
        "  saúde ": ["6"],
        "a\\": ["3"],
        "sms": ["1", "2", "3", "4", "5", "6"],
    }
    assert {q: sorted(ids(RequestFilter(q=q).apply(df))) for q in expected} == expected


def test_date_range_is_inclusive_by_calendar_day(spark):
    days = ("2024-01-31 23:59:59", "2024-02-01 00:00:00", "2024-02-29 23:59:59.9", "2024-03-01 00:00:00", None)
    df = H.detail(spark, [{"data_inicio": d} for d in days])
    filt = RequestFilter(data_inicio_from=dt.date(2024, 2, 1), data_inicio_to="2024-02-29")
    assert ids(filt.apply(df)) == ["2", "3"]


def test_equality_filters_combine(spark):
    df = H.detail(spark, [{"status": "a", "situacao": "x"}, {"status": "a", "situacao": "y"}, {"status": None, "situacao": "y"}])
    assert ids(RequestFilter(status="a", situacao="y").apply(df)) == ["2"]
    assert ids(RequestFilter(status="it's").apply(df)) == []


def test_sort_whitelist():
    assert sort_column("status") == "status"
    assert sort_column("longitude; drop") == "data_inicio"
    assert sort_column(None) == "data_inicio"


@pytest.fixture(scope="module")
def mixed(spark):
    """120 rows: one heavy sort value, NULLs and distinct values."""
    rows = []
    for i in range(120):
        status = "heavy" if i % 3 == 0 else None if i % 3 == 1 else f"s{i % 7}"
        rows.append({"id_chamado": f"{i:03d}", "status": status, "data_fim": f"2024-01-{i % 28 + 1:02d} 01:02:03" if i % 4 else None})
    return H.detail(spark, rows).cache()


@pytest.mark.parametrize("sort_by, sort_order", [("status", "asc"), ("status", "desc"), ("data_fim", "desc")])
def test_pages_join_to_the_sorted_list(mixed, sort_by, sort_order):
    """Direct and narrowed pages alike, NULLs last both ways."""
    rows = [r.asDict() for r in mixed.collect()]
    present = sorted(
        (r for r in rows if r[sort_by] is not None),
        key=lambda r: (r[sort_by], r["id_chamado"]),
        reverse=sort_order == "desc",
    )
    absent = sorted((r for r in rows if r[sort_by] is None), key=lambda r: r["id_chamado"], reverse=sort_order == "desc")
    want = [r["id_chamado"] for r in present + absent]
    for direct_rows in (10, 100_000):
        got = []
        for page in range(1, 5):
            got += ids(listing.list_page(mixed, RequestFilter(), page, 37, sort_by, sort_order, direct_rows=direct_rows))
        assert got == want


def test_page_past_the_end_is_the_last(mixed):
    last = listing.list_page(mixed, RequestFilter(), 4, 37, "id_chamado", "asc")
    assert ids(listing.list_page(mixed, RequestFilter(), 99, 37, "id_chamado", "asc")) == ids(last)
    assert listing.page_info(mixed, RequestFilter(), 99, 37).first().asDict() == {
        "total": 120, "page": 4, "page_size": 37, "pages": 4,
    }


def test_empty_list_is_page_one_of_one(mixed):
    nothing = RequestFilter(q="__nada__")
    assert ids(listing.list_page(mixed, nothing, 5)) == []
    assert listing.page_info(mixed, nothing, 5).first().asDict() == {
        "total": 0, "page": 1, "page_size": 20, "pages": 1,
    }


@pytest.mark.parametrize("bad", [{"page": 0}, {"page_size": 0}, {"page_size": 101}, {"sort_order": "up"}])
def test_bad_paging_is_refused(mixed, bad):
    with pytest.raises(ValueError):
        listing.list_page(mixed, RequestFilter(), **bad)


def test_filter_options_cascade(spark):
    df = H.detail(
        spark,
        [
            {"tipo": "a", "status": "x", "secretaria": "SMS"},
            {"tipo": "b", "status": "x", "secretaria": "SMS"},
            {"tipo": "c", "status": None, "secretaria": "SME"},
        ],
    )
    got = H.rows_of(listing.filter_options(df, RequestFilter(secretaria="SMS")))
    assert got == [("secretaria", "SMS"), ("status", "x"), ("tipo", "a"), ("tipo", "b")]
    assert [r[0] for r in listing.distinct_values(df, "tipo", RequestFilter()).collect()] == ["a", "b", "c"]
    assert listing.distinct_values(df, "longitude", RequestFilter()).count() == 0


def test_csv_export_keeps_every_row_in_order(spark, tmp_path):
    df = H.detail(
        spark,
        [
            {"data_inicio": "2024-01-01 00:00:00", "tipo": 'diz "oi", e sai', "resolvido_no_prazo": "true"},
            {"data_inicio": "2024-01-02 10:11:12.5", "tipo": " espaço ", "dias_resolucao": 3},
            {"data_inicio": None, "tipo": ""},
        ],
    )
    path = str(tmp_path / "csv")
    listing.export_requests(df, RequestFilter(), path)
    files = sorted(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    import csv

    got = []
    for file in files:
        with file.open(newline="", encoding="utf-8") as f:
            got += list(csv.DictReader(f))
    assert [r["id_chamado"] for r in got] == ["2", "1", "3"]
    assert list(got[0]) == list(listing.LIST_COLUMNS)
    assert got[0]["data_inicio"] == "2024-01-02T10:11:12.500000"
    assert got[1]["data_inicio"] == "2024-01-01T00:00:00"
    assert got[1]["tipo"] == 'diz "oi", e sai'
    assert got[0]["tipo"] == " espaço "
    assert [r["resolvido_no_prazo"] for r in got] == ["False", "True", "False"]
    assert (got[0]["dias_resolucao"], got[1]["dias_resolucao"], got[2]["data_inicio"], got[2]["tipo"]) == ("3", "", "", "")
