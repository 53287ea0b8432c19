"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagekit.llm import exact_dedup, fill_in_middle, lattice_lm, mixing, packing, pii, quality_model, quality_rules, sharding, simhash, suffix_dedup, token_counts, turn_trie
from usagekit.session import ensure_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_totals(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return rows.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(restored, 256)).drop("output")


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_simhash_dedup, op2_mix_sources, op3_quality_trees, op4_suffix_dedup, op5_quality_rules, op6_token_rollups, op7_exact_dedup,
        op8_jump_sharding, op9_contextual_pii, op10_harmonic_packing, op11_turn_trie, op12_fill_in_middle, op13_lattice_lm,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op5_quality_rules": quality_rules.SQL, "op7_exact_dedup": exact_dedup.SQL,
        "op11_turn_trie": turn_trie.SQL, "op12_fill_in_middle": fill_in_middle.SQL,
    }
