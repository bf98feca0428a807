"""The registered query of each operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from typesift.llm import decontaminate, filter_audit, line_templates, near_dedup, packing, piece_bpe, pii, prefix_trie, quality, secrets, token_orc, toxicity, warc
from typesift.llm.oracles import ORACLES
from typesift.llm.session import table

__all__ = ["ORACLES", "QUERIES"]


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2(table(spark, sf_dir, "pages"))


def op3_hamming_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op3(table(spark, sf_dir, "documents"))


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4(table(spark, sf_dir, "documents"))


def op5_line_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.op5(table(spark, sf_dir, "documents"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.op6(spark, table(spark, sf_dir, "documents"))


def op7_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(table(spark, sf_dir, "documents"))


def op9_dfa_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op9(table(spark, sf_dir, "documents"))


def op10_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_piece_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.op11(table(spark, sf_dir, "documents"))


def op12_euler_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op12(table(spark, sf_dir, "conversations"))


def op13_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_decontamination, op2_salvage_warc, op3_hamming_near_dedup, op4_rule_cascade, op5_line_template_tree,
        op6_token_orc, op7_nb_ngram_toxicity, op8_pattern_packing, op9_dfa_secrets, op10_anchor_pii,
        op11_piece_merge_rounds, op12_euler_prefix_trie, op13_survival_words)}
