"""The rank index of a build: where in a sorted list each range of keys begins.

For every sort column the detail fact is cut into key ranges, and their rows are counted
by opening month. A page's place is then found by prefix sums over these counts, and only
its range is read, from the months that have rows in it. The index answers lists without
a filter and lists of whole months; others are narrowed by counting (``plans.listing``).

Only lists of a published build use it, so no request id is NULL or repeats.
"""

from __future__ import annotations

import calendar
import datetime as dt
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requestmarts.operators.filters import RequestFilter, in_months
from requestmarts.operators.ranges import ID, SAMPLED_PER_SPLIT, SPLITS, Splits, placed, sample, splits_of
from requestmarts.schema import FILTER_COLUMNS, OPENED_MONTH, SORTABLE_COLUMNS, STORED_DETAIL_SCHEMA

RANK_SPLITS, RANK_COUNTS = "rank_splits", "rank_counts"
SPLITS_SCHEMA = "sort_column string, place int, value string, id string"


def rank_index(detail: DataFrame, most: int = SPLITS) -> tuple[DataFrame, DataFrame]:
    """(splits, counts) of a stored detail fact.

    One scan samples the sort columns, one counts: every row is placed in the ranges of all
    sort columns and collapses map-side, so what is shuffled is counts.
    """
    scoped = RequestFilter().apply(detail)
    kinds = dict(detail.dtypes)
    sampled, _ = sample(scoped, SORTABLE_COLUMNS, most * SAMPLED_PER_SPLIT)
    splits = [splits_of(sampled, c, kinds[c], False, most, apart=True) for c in SORTABLE_COLUMNS]
    listed = [(s.column, i, *key) for s in splits for i, key in enumerate(s.keys)]
    return detail.sparkSession.createDataFrame(listed, SPLITS_SCHEMA), counted(detail, splits)


def counted(detail: DataFrame, splits: Sequence[Splits]) -> DataFrame:
    """Rows of a stored detail fact by sort column, range and month."""
    places = placed(RequestFilter().apply(detail), splits, OPENED_MONTH)
    rows = places.groupBy("of", "place", OPENED_MONTH).agg(F.count(F.lit(1)).alias("rows"))
    named = F.get(F.array(*(F.lit(s.column) for s in splits)), F.col("of")).alias("sort_column")
    return rows.select(named, "place", OPENED_MONTH, "rows")


def stored_splits(spark: SparkSession, build: str, column: str) -> Splits:
    """The splits of a sort column, in ascending order."""
    kept = spark.read.parquet(f"{build}/{RANK_SPLITS}").where(F.col("sort_column") == column).orderBy("place").collect()
    kinds = {f.name: f.dataType.simpleString() for f in STORED_DETAIL_SCHEMA}
    return Splits(column, kinds[column], False, tuple((r["value"], r["id"]) for r in kept))


def whole_months(filt: RequestFilter) -> bool:
    """The filter asks for nothing but departments in scope and whole months."""
    if any(getattr(filt, c) for c in FILTER_COLUMNS) or (filt.q and filt.q.strip()):
        return False
    begins = not filt.data_inicio_from or _day(filt.data_inicio_from).day == 1
    last = _day(filt.data_inicio_to) if filt.data_inicio_to else None
    return begins and (last is None or last.day == calendar.monthrange(last.year, last.month)[1])


def _day(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(str(value)[:10])


@dataclass(frozen=True)
class Found:
    """Where a page is: rows of its ranges, the rows before it in them, and how many there are."""

    total: int
    offset: int
    size: int
    rows_in_ranges: int
    predicate: Column


def locate(
    spark: SparkSession, build: str, filt: RequestFilter, column: str, descending: bool, page: int, page_size: int
) -> Found | None:
    """The ranges that hold a page; a page past the end is the last one. None for an empty list.

    Reads at most one row of the index for each range and month.
    """
    counts = spark.read.parquet(f"{build}/{RANK_COUNTS}").where(F.col("sort_column") == column)
    if filt.data_inicio_from or filt.data_inicio_to:
        counts = counts.where(reduce(lambda a, b: a & b, filt.months()))
    by_place = {
        r["place"]: (r["n"], {m["m"] for m in r["months"]})
        for r in counts.groupBy("place")
        .agg(F.sum("rows").alias("n"), F.collect_set(F.struct(F.col(OPENED_MONTH).alias("m"))).alias("months"))
        .collect()
    }
    total = sum(n for n, _ in by_place.values())
    if not total:
        return None
    splits = stored_splits(spark, build, column)
    keys = splits.keys
    # Ranges in list order: descending lists are read backwards, but NULLs stay last.
    nulls = next(i for i, k in enumerate(keys) if k[0] is None) + 1
    places = list(range(len(keys) + 1))
    if descending:
        places = [*reversed(places[:nulls]), *reversed(places[nulls:])]
    offset = (min(page, -(-total // page_size)) - 1) * page_size
    size = min(page_size, total - offset)
    before = list(accumulate((by_place.get(p, (0,))[0] for p in places), initial=0))
    first, last = bisect_right(before, offset) - 1, bisect_left(before, offset + size) - 1
    chosen = places[first : last + 1]
    months = set().union(*(by_place[p][1] for p in chosen if p in by_place))
    # Neighbours in the list are neighbours among the ranges, but for the step to the NULLs.
    runs = [[p for p in chosen if p < nulls], [p for p in chosen if p >= nulls]]
    inside = reduce(or_, (splits.between(min(r), max(r)) for r in runs if r))
    return Found(total, offset - before[first], size, before[last + 1] - before[first], in_months(months) & inside)
