"""Registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from closeline.llm import bpe, decontamination, language, licenses, lines, negatives, partenum, rules, sharding, simhash, suffix_tree, toxicity, variants
from closeline.llm.texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"))


@query
def op6_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op6_rule_ledger"] = rules.SQL


@query
def op8_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard(table(spark, folder, "documents"))
    return sharded.select("doc_id", *sharding.OUTPUT)


@query
def op4_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_suffix_tree_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = suffix_tree.score(docs, ~suffix_tree.held_out())
    return scored.select("doc_id", suffix_tree.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(table(spark, folder, "documents"))


@query
def op11_simhash_planes(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(table(spark, folder, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return negatives.mine(table(spark, folder, "embeddings"), F.expr("vec_id % 50 = 0"), label=noisy)


ORACLES["op13_hard_negatives"] = negatives.SQL
