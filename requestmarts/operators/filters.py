"""Request filters: optional equalities, a date range and free-text search."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestmarts.functions import semantics as S
from requestmarts.schema import (
    DEFAULT_SORT,
    DEPARTMENTS,
    FILTER_COLUMNS,
    OPENED_MONTH,
    SEARCH_COLUMNS,
    SORTABLE_COLUMNS,
)


def search(text: str, columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    """The trimmed text occurs in any of the searched columns."""
    return reduce(or_, (S.contains_text(F.col(c), text.strip()) for c in columns))


def in_months(months: set[dt.date | None], column: str = OPENED_MONTH) -> Column:
    """Rows of the given months, None being the rows without one."""
    named = sorted(m for m in months if m is not None)
    parts = [F.col(column).isin(named)] if named else []
    if None in months:
        parts.append(F.col(column).isNull())
    return reduce(or_, parts) if parts else F.lit(False)


def not_in_months(months: set[dt.date | None], column: str = OPENED_MONTH) -> Column:
    """All other rows."""
    return ~F.coalesce(in_months(months, column), F.lit(False))


def sort_column(name: str | None) -> str:
    return name if name in SORTABLE_COLUMNS else DEFAULT_SORT


@dataclass(frozen=True)
class RequestFilter:
    """What a list, an export or a dashboard is restricted to. Empty means absent."""

    q: str | None = None
    tipo: str | None = None
    subtipo: str | None = None
    secretaria: str | None = None
    status: str | None = None
    situacao: str | None = None
    data_inicio_from: dt.date | str | None = None
    data_inicio_to: dt.date | str | None = None

    @property
    def active(self) -> bool:
        """Any parameter given. A blank search counts although it filters nothing."""
        return any(vars(self).values())

    def predicate(self) -> Column:
        """Everything asked for, and always the departments in scope."""
        opened = F.col("data_inicio").cast("date")
        parts = [F.col("secretaria").isin(*DEPARTMENTS)]
        parts += [F.col(c) == getattr(self, c) for c in FILTER_COLUMNS if getattr(self, c)]
        if self.data_inicio_from:
            parts.append(opened >= S.date_literal(self.data_inicio_from))
        if self.data_inicio_to:
            parts.append(opened <= S.date_literal(self.data_inicio_to))
        if self.q and self.q.strip():
            parts.append(search(self.q))
        return reduce(and_, parts)

    def months(self) -> list[Column]:
        """What the opening dates asked for mean for the month directories."""
        month, parts = F.col(OPENED_MONTH), []
        if self.data_inicio_from:
            parts.append(month >= F.trunc(S.date_literal(self.data_inicio_from), "month"))
        if self.data_inicio_to:
            parts.append(month <= F.trunc(S.date_literal(self.data_inicio_to), "month"))
        return parts

    def apply(self, detail: DataFrame) -> DataFrame:
        """The rows asked for; of a stored detail fact only the months they can be in are read."""
        months = self.months() if OPENED_MONTH in detail.columns else []
        return detail.where(reduce(and_, months, self.predicate()))
