"""What a build keeps of the values that filters compare: options and text search.

The dictionary has one row for each combination of filter columns and opening month, with
the days of that month as bits. Filter options under any column and date filter are read
from it alone. Text search looks into the filter columns and the request id: combinations
that hold the text are found in the dictionary, and for ids there are postings, the months
in which a piece of three characters occurs in any id. Only months that can hold the text
are read from the fact, and every row is still compared.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requestmarts.functions import semantics as S
from requestmarts.operators.filters import RequestFilter, in_months, search
from requestmarts.operators.ranges import ID
from requestmarts.plans import cubes
from requestmarts.schema import FILTER_COLUMNS, OPENED_MONTH
from requestmarts.sources.readers import DETAIL, read_mart

DICTIONARY, ID_PIECES = "dictionary", "id_pieces"
PIECE = 3
_EVERY_DAY = (1 << 32) - 1

#: Opening months; None is every month.
Months = set | None


def dictionary(detail: DataFrame) -> DataFrame:
    """(filter columns, month, days, rows) of a stored detail fact; bit d of ``days`` is day d.

    One scan of six columns. Requests collapse map-side to the combinations of their task.
    """
    day = F.expr("case when data_inicio is null then 0L else shiftleft(1L, dayofmonth(data_inicio)) end")
    return detail.groupBy(OPENED_MONTH, *FILTER_COLUMNS).agg(
        F.bit_or(day).alias("days"), F.count(F.lit(1)).alias("rows")
    )


def id_pieces(detail: DataFrame) -> DataFrame:
    """(piece, month): every three characters in a row of a request id, in lower case, and where they occur.

    The pieces of a task collapse to distinct ones before anything is shuffled.
    """
    ids = detail.select(OPENED_MONTH, F.lower(ID).alias("id")).where(F.length("id") >= PIECE)
    starts = ids.select(OPENED_MONTH, "id", F.explode(F.sequence(F.lit(1), F.length("id") - (PIECE - 1))).alias("at"))
    return starts.select(F.col("id").substr(F.col("at"), F.lit(PIECE)).alias("piece"), OPENED_MONTH).distinct()


def _days_asked(filt: RequestFilter) -> Column:
    """Bits of the days that the opening dates leave of a dictionary row's month."""
    left = F.lit(_EVERY_DAY).cast("bigint")
    for asked, bits in ((filt.data_inicio_from, "shiftleft(-1L, dayofmonth({d}))"), (filt.data_inicio_to, "shiftleft(2L, dayofmonth({d})) - 1L")):
        if asked:
            day = S.date_literal(asked)
            kept = F.expr(bits.format(d=f"date'{str(asked)[:10]}'"))
            left = left.bitwiseAND(F.when(F.col(OPENED_MONTH) == F.trunc(day, "month"), kept).otherwise(F.lit(-1).cast("bigint")))
    return left


def _stored_dictionary(spark: SparkSession, build: str, filt: RequestFilter) -> DataFrame:
    """Combinations of the requests that the filter leaves, its text compared with the filter columns only."""
    parts = [RequestFilter(**{c: getattr(filt, c) for c in FILTER_COLUMNS}).predicate(), *filt.months()]
    if filt.data_inicio_from or filt.data_inicio_to:
        parts.append(F.col("days").bitwiseAND(_days_asked(filt)) != 0)
    if _text(filt):
        parts.append(search(filt.q, FILTER_COLUMNS))
    return read_mart(spark, DICTIONARY, build).where(reduce(and_, parts))


def _text(filt: RequestFilter) -> str:
    return (filt.q or "").strip()


def pieces_of(spark: SparkSession, text: str) -> set[str]:
    """Pieces that every match of the text has; none if its runs between wildcards are too short."""
    lowered = spark.range(1).select(F.lower(F.lit(text))).first()[0]
    runs = re.split("[%_]", lowered)
    return {run[i : i + PIECE] for run in runs for i in range(len(run) - PIECE + 1)}


def months_of_ids(spark: SparkSession, build: str, text: str) -> Months:
    """Months in which a request id may hold the text: those in which all of its pieces occur."""
    pieces = pieces_of(spark, text)
    if not pieces:
        return None
    postings = read_mart(spark, ID_PIECES, build).where(F.col("piece").isin(sorted(pieces)))
    complete = postings.groupBy(OPENED_MONTH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(pieces))
    return {r[0] for r in complete.select(OPENED_MONTH).collect()}  # at most one row a month


def served_rows(spark: SparkSession, build: str, filt: RequestFilter) -> DataFrame:
    """The filtered rows of a build's fact; a text search reads only months that can hold the text."""
    rows = filt.apply(read_mart(spark, DETAIL, build))
    text = _text(filt)
    by_id = months_of_ids(spark, build, text) if text else None
    if by_id is None:
        return rows
    found = _stored_dictionary(spark, build, filt).select(OPENED_MONTH).distinct()
    months = by_id | {r[0] for r in found.collect()}  # at most one row a month
    return rows.where(in_months(months))


def served_combinations(spark: SparkSession, build: str, filt: RequestFilter) -> DataFrame:
    """Combinations of filter columns that the filter leaves.

    From the dictionary; only if request ids may hold a searched text, their months are
    read from the fact as well.
    """
    found = _stored_dictionary(spark, build, filt).select(*FILTER_COLUMNS)
    text = _text(filt)
    if not text:
        return found.distinct()
    by_id = months_of_ids(spark, build, text)
    if by_id is None or by_id:
        rows = filt.apply(read_mart(spark, DETAIL, build))
        near = rows if by_id is None else rows.where(in_months(by_id))
        found = found.unionByName(near.where(S.contains_text(F.col(ID), text)).select(*FILTER_COLUMNS))
    return found.distinct()


def cube_answer(spark: SparkSession, build: str, filt: RequestFilter) -> cubes.Answer | None:
    """A text search as a question to the widest cube, which has all searched columns but the id;
    None if an id may hold the text."""
    text = _text(filt)
    if not text or months_of_ids(spark, build, text) != set():
        return None
    return cubes.answer_from(spark, build, filt, cubes.WIDEST)
