"""Quality rules as a bitmask ledger, in built-in functions only.

``ledger`` evaluates every rule once for each row: measurements and one long whose
bit ``i`` is set if rule ``i`` failed. A policy is a versioned mask over these bits,
so it is applied, compared or changed without reading a text again. ``ablations``
adds up failure masks first and then tells, for each policy and rule, how many rows
fail it, fail only it, and would be kept without it.

Null and empty texts have no word; they fail the length rule. A 3-word window is
compared by the 64-bit hash of its words within one text (in a text of 20,000
words two different windows agree by chance once in about 1e11 texts).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.llm.text import NOT_BLANK


@dataclass(frozen=True)
class Rule:
    """A condition, over the measurements, under which a document fails."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(4, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(5, "emphasis", "10 * n_exclamations > 3 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_windows")
#: Versioned policies: the rules that count.
POLICIES = {
    "base-1": BASE_RULES,
    "web-1": (*BASE_RULES, "symbols", "word_length", "duplicate_lines"),
    "web-2": (*BASE_RULES, "symbols", "word_length", "duplicate_lines", "emphasis"),
}
CURRENT = "web-2"


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def measured(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id and the measurements that rules refer to."""
    words = docs.select(
        F.col(id_column),
        F.expr("coalesce(text, '')").alias("_text"),
        F.expr(f"regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}', 0)".replace("\\", "\\\\")).alias("_words"),
        F.expr("filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')").alias("_lines"),
    )
    # Hash and start of each window, equal windows side by side.
    windows = words.withColumn(
        "_windows",
        F.expr(
            "sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)),"
            " (w, i) -> struct(xxhash64(w, get(_words, i + 1), get(_words, i + 2)) as h, i as i)))"
        ),
    )
    twice = windows.withColumn(
        "_twice",
        F.expr(
            "filter(_windows, (x, k) -> coalesce(get(_windows, k + 1).h = x.h, false)"
            " or coalesce(get(_windows, k - 1).h = x.h, false))"
        ),
    )
    return twice.select(
        id_column,
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(_words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(_text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr(
            "cast(size(array_distinct(flatten(transform(_twice, x -> array(x.i, x.i + 1, x.i + 2))))) as bigint)"
        ).alias("n_repeat_words"),
        F.expr("cast(size(_lines) as bigint)").alias("n_lines"),
        F.expr("cast(regexp_count(_text, '!') as bigint)").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Measurements and failure bits; every rule is evaluated once."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES],
    )
    return measured(docs, id_column).withColumn("failed_bits", bits)


def apply_policy(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the policy's version."""
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return ledger_rows.withColumns(
        {"base_failed": base, "kept": (failed == 0) & ~base, "policy": F.lit(version)}
    )


def ablations(ledger_rows: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule: rows that fail it, fail it alone, and are kept with and without it.

    Rows collapse to their distinct masks (at most 2 to the number of rules) before
    anything else, so the text table is read once and next to nothing is shuffled.
    """
    masks = ledger_rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("_n"))
    pairs = [
        (version, mask(names), r.name, 1 << r.bit)
        for version, names in (policies or POLICIES).items()
        for r in RULES
        if r.name in names
    ]
    # At most one row for each mask, policy and rule: bounded by the rule list, not by the data.
    listed = F.array(
        *[
            F.struct(F.lit(v).alias("policy"), F.lit(m).alias("mask"), F.lit(n).alias("rule"), F.lit(b).alias("bit"))
            for v, m, n, b in pairs
        ]
    )
    each = masks.select("failed_bits", "_n", F.explode(listed).alias("p")).select(
        "_n",
        "p.*",
        F.expr("failed_bits & p.mask").alias("hit"),
    )
    total = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("_n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(
        total("hit & bit <> 0").alias("failed"),
        total("hit = bit").alias("failed_only_this"),
        total("hit = 0").alias("kept"),
        total("hit & ~bit = 0").alias("kept_without"),
    )
