"""A refreshed build against a full build of the same requests."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from requestmarts.operators.filters import RequestFilter
from requestmarts.plans import listing, rank_index
from requestmarts.plans.dashboard import collected, served_dashboard
from requestmarts.plans.pipeline import ContractError, build_marts, refresh_marts
from requestmarts.schema import OPENED_MONTH
from requestmarts.sources import pointers, readers, standin
from tests import helpers as H

STAMPS = {"start": standin.SINCE, "as_of": standin.AS_OF, "built_at": standin.BUILT_AT}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """(first build, refreshed once, refreshed twice, full build), and the raw requests of the last."""
    sf_dir = "/root/testdata/sf0.001"
    raw = standin.requests(spark, sf_dir)
    seeds, areas = standin.type_map(spark), standin.neighbourhoods(spark, sf_dir)
    place = F.col("id_chamado").cast("long")
    # Second round: late ones. Third round: moved to another month, out of scope, without a date, closed.
    late = raw.where(place % 5 == 0)
    moved = raw.where(place % 7 == 1).withColumn("data_inicio", F.expr("data_inicio - interval 75 days"))
    gone = raw.where(place % 7 == 2).withColumn("tipo", F.lit("MACHINERY-2"))
    undated = raw.where(place % 29 == 3).where(place % 7 > 2).withColumn("data_inicio", F.lit(None).cast("timestamp_ntz"))
    corrected = moved.unionByName(gone).unionByName(undated)
    out = str(tmp_path_factory.mktemp("marts"))
    first = build_marts(raw.where(place % 5 != 0), seeds, areas, out, **STAMPS | {"as_of": "2001-10-10"})
    once = refresh_marts(late, seeds, areas, out, **STAMPS | {"as_of": "2001-11-30"})
    twice = refresh_marts(corrected, seeds, areas, out, **STAMPS)
    final = raw.join(corrected.select("id_chamado"), "id_chamado", "left_anti").select(raw.columns).unionByName(corrected)
    full = build_marts(final, seeds, areas, str(tmp_path_factory.mktemp("full")), **STAMPS)
    return first, once, twice, full, out


def tables(build):
    return sorted(t for t in os.listdir(build) if t != readers.MONTHS_TABLE)


def test_every_table_equals_a_full_build(spark, folders):
    _, _, twice, full, _ = folders
    assert tables(twice) == tables(full)
    for table in tables(full):
        got, want = readers.read_mart(spark, table, twice), readers.read_mart(spark, table, full)
        if table == rank_index.RANK_SPLITS:
            continue  # The ranges are those of the first build.
        if table == rank_index.RANK_COUNTS:
            got, want = (d.groupBy("sort_column", OPENED_MONTH).agg(F.sum("rows")) for d in (got, want))
        assert sorted(got.columns) == sorted(want.columns), table
        assert H.rows_of(got.select(sorted(got.columns))) == H.rows_of(want.select(sorted(want.columns))), table


def test_answers_equal_a_full_build(spark, folders):
    _, _, twice, full, _ = folders
    for filt in (RequestFilter(), RequestFilter(tipo="HOUSEHOLD-1", data_inicio_from="1998-01-10"), RequestFilter(q="12"), RequestFilter(q="urgent")):
        got, want = (collected(served_dashboard(spark, filt, as_of=standin.AS_OF, build=b)) for b in (twice, full))
        assert got == want
        assert listing.served_options(spark, filt, build=twice).collect() == listing.served_options(spark, filt, build=full).collect()
        for page in (1, 4, 99):
            got, want = (listing.served_page(spark, filt, page, 50, "tipo", "asc", build=b, direct_rows=60).collect() for b in (twice, full))
            assert got == want


def test_unchanged_months_stay_where_they_are(spark, folders):
    first, once, twice, full, out = folders
    assert readers.months_kept(spark, first) is None and readers.months_kept(spark, full) is None
    kept = readers.months_kept(spark, twice)
    assert twice in kept and set(kept) <= {first, once, twice}
    months = [m for own in kept.values() for m in own]
    assert len(months) == len(set(months)) and None in months
    assert pointers.current(spark, out) == twice


def test_a_refresh_writes_only_its_month(spark, folders, tmp_path):
    _, _, twice, _, out = folders
    seeds, areas = standin.type_map(spark), standin.neighbourhoods(spark, "/root/testdata/sf0.001")
    one = standin.requests(spark, "/root/testdata/sf0.001").where("data_particao >= '1999-03-05'").orderBy("data_particao", "id_chamado").limit(1)
    one = one.withColumn("id_chamado", F.lit("new one")).withColumn("tipo", F.lit("HOUSEHOLD-1"))
    again = refresh_marts(one, seeds, areas, out, **STAMPS)
    wrote = [d for d in os.listdir(f"{again}/{readers.DETAIL}") if d.startswith(OPENED_MONTH)]
    assert len(wrote) == 1
    before, after = (readers.read_mart(spark, readers.DETAIL, b).count() for b in (twice, again))
    assert after == before + 1
    # Nothing changed: nothing is written, and the rows are the same.
    same = refresh_marts(one.limit(0), seeds, areas, out, **STAMPS)
    assert readers.read_mart(spark, readers.DETAIL, same).count() == after
    with pytest.raises(ValueError, match="repeat"):
        refresh_marts(one.union(one), seeds, areas, out, **STAMPS)
    with pytest.raises(ContractError, match="not_null"):
        refresh_marts(one.withColumn("id_chamado", F.lit(None).cast("string")), seeds, areas, out, **STAMPS)
    assert pointers.current(spark, out) == same
    with pytest.raises(LookupError):
        refresh_marts(one, seeds, areas, str(tmp_path / "none"), **STAMPS)
