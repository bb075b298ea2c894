"""Lists: one page, page counts, filter options and the CSV export."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requestmarts.operators.filters import RequestFilter, sort_column
from requestmarts.operators.ranges import ID, SAMPLED_PER_SPLIT, SPLITS, Splits, placed, sample, splits_of
from requestmarts.plans import rank_index, search_index
from requestmarts.schema import FILTER_COLUMNS, LIST_COLUMNS
from requestmarts.sources.readers import DETAIL, current_build, read_mart

# --- fixed values -------------------------------------------------------------
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
# ------------------------------------------------------------------------------

# Rows that may meet in one task to find a page; a list with more is narrowed first.
DIRECT_ROWS = 100_000


def _check_paging(page: int, page_size: int, sort_order: str) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be asc or desc")


def ordering(sort_by: str | None, sort_order: str) -> list[Column]:
    """The asked column, NULLs last, then the request id so that pages never overlap."""
    columns = (F.col(sort_column(sort_by)), F.col("id_chamado"))
    if sort_order == "desc":
        return [c.desc_nulls_last() for c in columns]
    return [c.asc_nulls_last() for c in columns]


def _from_the_end(sort_by: str | None, sort_order: str) -> list[Column]:
    """The same order read backwards."""
    columns = (F.col(sort_column(sort_by)), F.col("id_chamado"))
    if sort_order == "desc":
        return [c.asc_nulls_first() for c in columns]
    return [c.desc_nulls_first() for c in columns]


def page_info(detail: DataFrame, filt: RequestFilter, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Total, number of pages (at least one) and the page actually shown."""
    _check_paging(page, page_size, "asc")
    counted = filt.apply(detail).agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / page_size), F.lit(1).cast("bigint"))
    return counted.select(
        "total",
        F.least(F.lit(page).cast("bigint"), pages).alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        pages.alias("pages"),
    )


def _narrow(rows: DataFrame, splits: Splits, offset: int, size: int) -> tuple[DataFrame, int, int]:
    """Only the part of the list around the page: (rows, offset in them, how many).

    One scan counts the ranges between the splits. Where the splits are decides how much
    is cut off, never what is shown.
    """
    counted = placed(rows, [splits]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["place"]: r["n"] for r in counted.collect()}
    before = list(accumulate((counts.get(i, 0) for i in range(len(splits.keys) + 1)), initial=0))
    first = bisect_right(before, offset) - 1
    last = bisect_left(before, offset + size) - 1
    return rows.where(splits.between(first, last)), offset - before[first], before[last + 1] - before[first]


def _page(rows: DataFrame, offset: int, size: int, total: int, sort_by: str | None, sort_order: str) -> DataFrame:
    """A page of a list of ``total`` rows by a top-k from its nearer end."""
    order, after = ordering(sort_by, sort_order), total - offset - size
    if after < offset:
        return rows.orderBy(*_from_the_end(sort_by, sort_order)).offset(after).limit(size).orderBy(*order)
    return rows.orderBy(*order).offset(offset).limit(size)


def _narrowed_page(
    rows: DataFrame, offset: int, size: int, total: int, sort_by: str | None, sort_order: str, direct_rows: int, sampled: list | None
) -> DataFrame:
    """A page in the list, narrowed by rounds until at most ``direct_rows`` rows can meet in a task."""
    column, descending = sort_column(sort_by), sort_order == "desc"
    kind = dict(rows.dtypes)[column]
    while total > direct_rows and min(offset, total - offset - size) + size > direct_rows:
        if sampled is None:
            sampled, _ = sample(rows, [column], SPLITS * SAMPLED_PER_SPLIT)
        splits = splits_of(sampled, column, kind, descending)
        narrowed, near, left = _narrow(rows, splits, offset, size)
        if left == total:
            break
        rows, offset, total, sampled = narrowed, near, left, None
    return _page(rows, offset, size, total, sort_by, sort_order)


def list_page(
    detail: DataFrame,
    filt: RequestFilter,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort_by: str | None = None,
    sort_order: str = "desc",
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One page of the filtered, sorted list. A page past the end is the last one.

    The first and the last page are a top-k: each task keeps a page of rows. Any
    other is first narrowed to the ranges around it, until at most ``direct_rows``
    rows can meet in a task: one scan counts and samples, one counts ranges, one reads
    a range. A round cuts about a thousandfold, so one is enough for 1e8 rows and two
    for 1e11. ``served_page`` has the counts of a build and needs the last scan only.
    """
    _check_paging(page, page_size, sort_order)
    rows = filt.apply(detail).select(*LIST_COLUMNS)
    if page == 1:
        return rows.orderBy(*ordering(sort_by, sort_order)).limit(page_size)
    # The scan that counts the list samples it as well.
    sampled, total = sample(rows, [sort_column(sort_by)], SPLITS * SAMPLED_PER_SPLIT)
    offset = (min(page, max(1, ceil(total / page_size))) - 1) * page_size
    size = min(page_size, total - offset)
    return _narrowed_page(rows, offset, size, total, sort_by, sort_order, direct_rows, sampled)


def served_page(
    spark: SparkSession,
    filt: RequestFilter,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort_by: str | None = None,
    sort_order: str = "desc",
    *,
    build: str | None = None,
    database: str | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One page of a build's list. Without a filter, or over whole months, its rank index tells
    where the page is, and only the ranges that hold it are read, from the months they are in.
    A text search reads only months that can hold the text."""
    _check_paging(page, page_size, sort_order)
    build = build or current_build(spark, database)
    detail = read_mart(spark, DETAIL, build)
    if page == 1 or not rank_index.whole_months(filt):
        rows = search_index.served_rows(spark, build, filt)
        return list_page(rows, filt, page, page_size, sort_by, sort_order, direct_rows)
    found = rank_index.locate(spark, build, filt, sort_column(sort_by), sort_order == "desc", page, page_size)
    rows = filt.apply(detail)
    if found is None:
        return rows.select(*LIST_COLUMNS).limit(0)
    near = rows.where(found.predicate).select(*LIST_COLUMNS)
    return _narrowed_page(near, found.offset, found.size, found.rows_in_ranges, sort_by, sort_order, direct_rows, None)


def distinct_values(detail: DataFrame, column: str, filt: RequestFilter) -> DataFrame:
    """Sorted values of one filter column under the filter; none for other columns."""
    if column not in FILTER_COLUMNS:
        return detail.sparkSession.createDataFrame([], "value string")
    values = filt.apply(detail).select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    return values.distinct().orderBy("value")


def filter_options(detail: DataFrame, filt: RequestFilter) -> DataFrame:
    """(column, value) for every filter column, so that one choice narrows the others.

    Distinct combinations come first: one hash lookup per request instead of five.
    """
    return _options(filt.apply(detail).select(*FILTER_COLUMNS).distinct())


def served_options(
    spark: SparkSession, filt: RequestFilter, *, build: str | None = None, database: str | None = None
) -> DataFrame:
    """The filter options of a build, read from its dictionary."""
    build = build or current_build(spark, database)
    return _options(search_index.served_combinations(spark, build, filt))


def served_values(
    spark: SparkSession, column: str, filt: RequestFilter, *, build: str | None = None, database: str | None = None
) -> DataFrame:
    """``distinct_values`` of a build, read from its dictionary."""
    if column not in FILTER_COLUMNS:
        return spark.createDataFrame([], "value string")
    found = search_index.served_combinations(spark, build or current_build(spark, database), filt)
    values = found.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    return values.distinct().orderBy("value")


def _options(combinations: DataFrame) -> DataFrame:
    values = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in FILTER_COLUMNS)
    )
    return (
        combinations.select(F.inline(values))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("column", "value")
    )


def _as_text(name: str, kind: str) -> Column:
    """ISO timestamps (six digits if fractional), True/False, otherwise as cast."""
    text = F.col(name).cast("string")
    if kind.startswith("timestamp"):
        padded = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
        text = F.translate(padded, " ", "T")
    elif kind == "boolean":
        text = F.initcap(text)
    return text.alias(name)


def export_rows(
    detail: DataFrame, filt: RequestFilter, sort_by: str | None = None, sort_order: str = "desc"
) -> DataFrame:
    """All filtered rows in list order, as the text a CSV shows."""
    _check_paging(1, DEFAULT_PAGE_SIZE, sort_order)
    rows = filt.apply(detail).select(*LIST_COLUMNS).orderBy(*ordering(sort_by, sort_order))
    return rows.select(*(_as_text(name, kind) for name, kind in rows.dtypes))


def export_requests(
    detail: DataFrame,
    filt: RequestFilter,
    path: str,
    sort_by: str | None = None,
    sort_order: str = "desc",
) -> None:
    """Write the export as CSV part files with headers, in order by file name.

    The sort is a range shuffle; the request id in its key splits a sort value
    that many rows share.
    """
    writer = export_rows(detail, filt, sort_by, sort_order).write.mode("errorifexists")
    for option, value in {
        "header": True,
        "escape": '"',
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }.items():
        writer = writer.option(option, value)
    writer.csv(path)
