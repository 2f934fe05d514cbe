"""The corpus pipeline: documents through rules, two dedups and a mix, to SentencePiece ids.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all rows
its predecessor kept, and all but the last return the columns of documents.
Stages are joined by written Parquet, so a lost executor costs one stage at
most.

Defined cases, of every stage: an empty table gives an empty one; null texts
count as empty; null ids and sources are values like others; repeated rows and
very long texts are taken whole; columns beside the documents' own, whatever
their names, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlake.llm import op2_mixing, op5_rules, op6_minhash, op8_sentencepiece, op10_exact_dedup
from driftlake.llm._spark import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learnt decision list rejects go; null and empty texts fail the base rule. Equal rows stay or go together."""
    return op5_rules.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the smallest doc_id stays, a null one last; of equal rows one stays. Null and empty texts are equal."""
    return op10_exact_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (five-word shingles, 0.8) the smallest doc_id stays.

    Null and empty texts are like nothing and stay; rows of one doc_id are one
    document; rows without doc_id stay where one of them is a component's first.
    """
    return op6_minhash.dedup(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, near its source's target. Documents without words go; equal rows are taken together."""
    return op2_mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of each document of the mix; null and empty texts have no pieces."""
    return op8_sentencepiece.encode(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: A learnt model and random rounding are not SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
