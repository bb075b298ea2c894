"""Data-quality checks: each returns what offends, the contract counts it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.schema import DEPARTMENTS


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows. NULLs are ignored."""
    return (
        df.select(*columns)
        .na.drop()
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, failures) for all columns, counted in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], list(columns), "column", "failures")


def check_accepted(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the list, with their number of rows. NULLs are ignored."""
    return (
        df.where(~F.col(column).isin(*values))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# The declared checks. Accepted values are the departments in scope.
CONTRACT: tuple[tuple[str, str, str], ...] = (
    ("stg_chamado", "id_chamado", "unique"),
    ("stg_chamado", "id_chamado", "not_null"),
    ("stg_chamado", "data_particao", "not_null"),
    ("int_chamados_enriched", "id_chamado", "unique"),
    ("int_chamados_enriched", "id_chamado", "not_null"),
    ("int_chamados_enriched", "secretaria", "not_null"),
    ("int_chamados_enriched", "secretaria", "accepted_values"),
    ("mart_chamados", "id_chamado", "unique"),
    ("mart_chamados", "id_chamado", "not_null"),
    ("mart_by_department", "secretaria", "not_null"),
    ("mart_by_department", "secretaria", "accepted_values"),
    ("mart_kpis", "total_chamados", "not_null"),
    ("mart_monthly_volume", "periodo", "not_null"),
    ("mart_monthly_volume", "total_chamados", "not_null"),
    ("mart_top_types", "tipo", "not_null"),
)


def _failures(df: DataFrame, wanted: dict[tuple[str, str], list[str]]) -> list[DataFrame]:
    """One pass for all not-null and accepted-value checks, one per unique check. ``wanted``
    has, for each (column, check), the tables it is reported for."""
    in_one_pass = {}
    for column, check in wanted:
        if check == "not_null":
            in_one_pass[column, check] = F.count_if(F.col(column).isNull())
        elif check == "accepted_values":
            unknown = F.when(~F.col(column).isin(*DEPARTMENTS), F.col(column))
            in_one_pass[column, check] = F.count_distinct(unknown)
    passes = []
    if in_one_pass:
        counts = df.agg(*(c.alias(f"{column} {check}") for (column, check), c in in_one_pass.items()))
        passes.append((counts, list(in_one_pass)))
    for column, check in wanted:
        if check == "unique":
            n = F.count(F.lit(1)).alias(f"{column} {check}")
            passes.append((check_unique(df, [column]).agg(n), [(column, check)]))
    out = []
    for counts, names in passes:
        rows = F.array(
            *(
                F.struct(
                    F.lit(table).alias("table"),
                    F.lit(column).alias("column"),
                    F.lit(check).alias("check"),
                    F.col(f"`{column} {check}`").alias("failures"),
                )
                for column, check in names
                for table in wanted[column, check]
            )
        )
        out.append(counts.select(F.inline(rows)))
    return out


def run_contract(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared check with its number of offending values (0 is a pass).

    Unique and accepted-value checks count distinct offending values, not-null
    checks count rows.
    """
    frames: dict[int, tuple[DataFrame, dict[tuple[str, str], list[str]]]] = {}
    for table, column, check in CONTRACT:
        if table not in tables:
            raise ValueError(f"no table {table} to check")
        # Tables that are one frame are read once.
        _, wanted = frames.setdefault(id(tables[table]), (tables[table], {}))
        wanted.setdefault((column, check), []).append(table)
    results = [counts for df, wanted in frames.values() for counts in _failures(df, wanted)]
    return reduce(DataFrame.unionByName, results)
