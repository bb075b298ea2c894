"""One query for each corpus operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requestmarts.llm import (
    decontaminate,
    divergence,
    filter_audit,
    langid,
    licenses,
    mixing,
    piecewise,
    pii,
    rules,
    sharding,
    simhash,
    suffixes,
    tokens,
)
from requestmarts.llm.sql import op4, op5, op9, op11, op12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_skip_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_covering_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))


def op5_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op6_pair_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_short_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_recurrent_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op9_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_column_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    lengths = F.transform("removed", lambda r: r[1] - r[0])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_removal_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_term_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compare_with_next(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_skip_chain_field,
        op2_label_propagation,
        op3_covering_anchors,
        op4_winnowing,
        op5_rule_ledger,
        op5_rule_ablations,
        op6_pair_merging,
        op7_short_notices,
        op8_recurrent_bytes,
        op9_hierarchical_budget,
        op10_column_wise,
        op11_removal_potentials,
        op12_term_transducers,
        op13_piecewise_hashes,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_winnowing": op4.SQL,
        "op5_rule_ledger": op5.SQL,
        "op5_rule_ablations": op5.ABLATIONS,
        "op9_hierarchical_budget": op9.SQL,
        "op11_removal_potentials": op11.SQL,
        "op12_term_transducers": op12.SQL,
    }
