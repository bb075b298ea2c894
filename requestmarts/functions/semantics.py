"""Scalar expressions with the exact semantics the marts rely on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from requestmarts.schema import OTHER_DEPARTMENT


def round_half_away(x: str, digits: int) -> str:
    """Scale, round halves away from zero, scale back, as SQL text.

    ``round(x, digits)`` works on the decimal text of ``x`` (1.005 -> 1.01).
    Rounding the scaled double to zero digits gives the usual double result.
    """
    scale = f"{10**digits}D"
    return f"(round({x} * {scale}, 0) / {scale})"


def pct(num: str, den: str, digits: int) -> Column:
    """Percentage of two SQL expressions as double, NULL on a zero denominator."""
    return F.expr(round_half_away(f"(100D * {num} / nullif({den}, 0))", digits))


def mean(total: str, n: str, digits: int) -> Column:
    """Mean from a sum and a count, as double, NULL over nothing."""
    return F.expr(round_half_away(f"(cast({total} as double) / nullif({n}, 0))", digits))


def department(c: Column) -> Column:
    return F.coalesce(c, F.lit(OTHER_DEPARTMENT))


def calendar_days(start: Column, end: Column) -> Column:
    """Calendar days from ``start`` to ``end``; may be negative, NULL if either is."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")


def days_to_resolution() -> Column:
    return calendar_days(F.col("data_inicio"), F.col("data_fim"))


def resolved_on_time() -> Column:
    """Closed at or before the deadline. False, never NULL, when either is missing."""
    return F.coalesce(F.col("data_fim") <= F.col("prazo_atendimento"), F.lit(False))


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")


def date_literal(d: dt.date | str | None) -> Column:
    """A date literal; None means today."""
    return F.current_date() if d is None else F.lit(str(d)).cast("date")


def build_time(ts: dt.datetime | str | None = None) -> Column:
    """The build stamp as a zone-free timestamp; None means now."""
    return F.localtimestamp() if ts is None else F.lit(str(ts)).cast("timestamp_ntz")


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive substring. ``%`` and ``_`` in the text stay wildcards, a
    backslash is an ordinary character."""
    escaped = text.replace("\\", "\\\\")
    return c.cast("string").ilike(f"%{escaped}%")
