"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, hard_negatives, jaccard_join, lexical_search, line_dedup, lm_score, oracles, quality_rules, secret_scan, sequence_packing, substring_dedup, token_counts, warc
from .common import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op3(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.op2(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op4(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op5(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op6(spark, table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op7(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op8(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op9(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op10(table(spark, sf_dir, "documents"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing.op11(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op12(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_lm_score, op3_quality_rules, op4_jaccard_join, op5_token_counts, op6_warc, op7_byte_bpe, op8_line_dedup, op9_substring_dedup, op10_secret_scan, op11_pack, op12_hard_negatives, op13_lexical_search)
}
#: BPE merges, trained scores, content-defined chunks and packing are not for SQL; tests/llm checks those queries against brute force.
SQL: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op3_quality_rules": oracles.QUALITY,
    "op4_jaccard_join": oracles.JACCARD,
    "op6_warc": oracles.WARC,
    "op10_secret_scan": oracles.SECRETS,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_lexical_search": oracles.LEXICAL,
}
