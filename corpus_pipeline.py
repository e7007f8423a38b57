"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet in the shared folder and rereads it
as the next stage's docs. All but the last keep the columns of documents; the last gives ids and digests per document.

Defined cases: a null or empty text fails the quality rules and goes there; a null doc_id is kept and stands by its text's
hash where documents are told apart; of repeated rows, which are copies of each other, the Jaccard stage keeps one; lines are
removed from texts, and n_chars follows them; other columns travel as they are, whatever their names; an empty documents or
benchmark table gives an empty result, or one from which nothing was taken out. Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from gridloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.stage(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("byte-level bpe", tokens)]

#: SQL has no BPE merges and no content-defined chunks; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
