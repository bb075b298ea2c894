"""Stored cubes that answer filtered dashboards without the detail fact.

A cube is the roll-up of ``operators.measures`` with further dimensions: some of the filter
columns, and the opening month. All are sums, so each smaller cube is summed from the
largest one. A filter is answered from the smallest cube that holds its columns. Opening
dates within a month are answered in two parts: whole months from the cube, the days of
the first and last month from the fact, of which only those months are read. Free text is
asked of the widest cube where no request id can hold it (``plans.search_index``).

The age of open requests is stored as of the build; as every one of them ages a day a day,
another date only adds to the sum.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from requestmarts.operators.filters import RequestFilter, not_in_months, search
from requestmarts.operators.measures import COUNTERS, DIMENSIONS, TERRITORY_DIMENSIONS, VOLUME_DIMENSIONS, measured, rollup
from requestmarts.schema import DEPARTMENTS, FILTER_COLUMNS

MONTH = "periodo"
CUBES_TABLE = "cubes"
CUBES_SCHEMA = "name string, columns string, rows long, as_of string"

#: Stored cubes: the dimensions each has besides those of the roll-up.
CUBES: dict[str, tuple[str, ...]] = {
    "cube_month": (MONTH,),
    "cube_type": ("tipo", "subtipo"),
    "cube_state": ("status", "situacao"),
    "cube_type_month": ("tipo", "subtipo", MONTH),
    "cube_state_month": ("status", "situacao", MONTH),
    "cube_all": ("tipo", "subtipo", "status", "situacao", MONTH),
}
WIDEST = "cube_all"
#: The roll-up itself answers filters by department alone.
ROLLUP = "rollup"


def largest(detail: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The cube with every filter column and the month, from one scan of the fact."""
    extra = [c for c in CUBES[WIDEST] if c not in DIMENSIONS]
    return rollup(measured(detail, as_of, extra), CUBES[WIDEST])


def summed(cube: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """A cube, or the roll-up if ``extra`` is empty, from one with more columns.

    Rows of the territory cube keep only territory columns and ``extra``, rows of the
    volume cube their own; the columns of the other kind are NULL in both.
    """

    def key(c: str) -> Column:
        if c in extra:
            return F.col(c)
        kinds = [k for k, own in (("territory", TERRITORY_DIMENSIONS), ("volume", VOLUME_DIMENSIONS)) if c in own]
        return F.col(c) if len(kinds) == 2 else F.when(F.col("cube") == kinds[0], F.col(c)).alias(c)

    columns = dict.fromkeys((*DIMENSIONS, *extra))
    return cube.groupBy("cube", *(key(c) for c in columns)).agg(
        *(F.sum(c).alias(c) for c in COUNTERS), F.max("newest_partition").alias("newest_partition")
    )


@dataclass(frozen=True)
class Answer:
    """A filter split into what a cube answers and what the fact must: either may be absent."""

    name: str
    as_of: dt.date
    months: RequestFilter | None
    days: tuple[RequestFilter, ...]


def _day(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(str(value)[:10])


def _month_end(day: dt.date) -> dt.date:
    return day.replace(day=calendar.monthrange(day.year, day.month)[1])


def split_by_month(filt: RequestFilter) -> tuple[RequestFilter | None, tuple[RequestFilter, ...]]:
    """(filter over whole months, filters over the days of its first and last month)."""
    start = _day(filt.data_inicio_from) if filt.data_inicio_from else None
    end = _day(filt.data_inicio_to) if filt.data_inicio_to else None
    if start and end and start > end:
        return replace(filt, data_inicio_from=start, data_inicio_to=end), ()
    part = lambda a, b: replace(filt, data_inicio_from=a, data_inicio_to=b)
    days = []
    if start and start.day > 1:
        days.append((start, min(_month_end(start), end) if end else _month_end(start)))
        start = _month_end(start) + dt.timedelta(1)
    if end and end < _month_end(end) and (not start or start <= end):
        days.append((max(end.replace(day=1), start) if start else end.replace(day=1), end))
        end = end.replace(day=1) - dt.timedelta(1)
    empty = start is not None and end is not None and start > end
    return None if empty else part(start, end), tuple(part(a, b) for a, b in days)


def needed(filt: RequestFilter) -> set[str] | None:
    """Columns a cube must have for the filter; None if no cube can answer it."""
    if filt.q and filt.q.strip():
        return None
    columns = {c for c in FILTER_COLUMNS if getattr(filt, c) and c != "secretaria"}
    return columns | ({MONTH} if filt.data_inicio_from or filt.data_inicio_to else set())


def match(spark: SparkSession, build: str, filt: RequestFilter) -> Answer | None:
    """The smallest stored cube that holds the filter's columns; None if the fact must answer."""
    columns = needed(filt)
    if columns is None:
        return None
    stored = spark.read.schema(CUBES_SCHEMA).parquet(f"{build}/{CUBES_TABLE}").collect()  # one row a cube
    fitting = [s for s in stored if columns <= set(filter(None, s["columns"].split(",")))]
    if not fitting:
        return None
    best = min(fitting, key=lambda s: (s["rows"], s["name"]))
    return _answer(best, filt)


def answer_from(spark: SparkSession, build: str, filt: RequestFilter, name: str) -> Answer:
    """The filter as a question to the named cube. A text is compared with the filter columns only."""
    stored = spark.read.schema(CUBES_SCHEMA).parquet(f"{build}/{CUBES_TABLE}")
    return _answer(stored.where(F.col("name") == name).first(), filt)


def kept(spark: SparkSession, build: str, months: set[dt.date | None], as_of: dt.date | str) -> DataFrame:
    """The widest cube of a build without the given months, with ages as of another date."""
    before = spark.read.schema(CUBES_SCHEMA).parquet(f"{build}/{CUBES_TABLE}").where(F.col("name") == WIDEST).first()
    older = F.expr(f"age_sum + datediff(date'{as_of}', date'{before['as_of']}') * age_n").alias("age_sum")
    cube = spark.read.parquet(f"{build}/{WIDEST}")
    return cube.where(not_in_months(months, MONTH)).withColumn("age_sum", older)


def _answer(stored: Row, filt: RequestFilter) -> Answer:
    months, days = split_by_month(filt)
    return Answer(stored["name"], _day(stored["as_of"]), months, days)


def _of_months(filt: RequestFilter) -> Column:
    """The filter over the columns of a cube."""
    out = F.col("secretaria").isin(*DEPARTMENTS)
    for c in FILTER_COLUMNS:
        if getattr(filt, c):
            out = out & (F.col(c) == getattr(filt, c))
    if filt.data_inicio_from:
        out = out & (F.col(MONTH) >= F.lit(_day(filt.data_inicio_from)))
    if filt.data_inicio_to:
        out = out & (F.col(MONTH) <= F.lit(_day(filt.data_inicio_to)))
    if filt.q and filt.q.strip():
        out = out & search(filt.q, FILTER_COLUMNS)
    return out


def rolled_up(spark: SparkSession, build: str, answer: Answer, detail: DataFrame, as_of: dt.date | str | None) -> DataFrame:
    """The roll-up of the filtered requests."""
    asked = f"date'{as_of}'" if as_of is not None else "current_date()"
    parts = []
    if answer.months is not None:
        cube = spark.read.parquet(f"{build}/{answer.name}").where(_of_months(answer.months))
        older = F.expr(f"age_sum + datediff({asked}, date'{answer.as_of}') * age_n").alias("age_sum")
        parts.append(summed(cube, ()).withColumn("age_sum", older))
    parts += [rollup(measured(days.apply(detail), as_of)) for days in answer.days]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
