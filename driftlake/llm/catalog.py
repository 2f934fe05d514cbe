"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_sharding, op2_mixing, op3_substring, op4_quality, op5_rules, op6_minhash, op7_pii, op8_sentencepiece, op9_warc, op10_exact_dedup, op11_funnels, op12_whitening, op13_chat


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sharding.shard(_t(spark, sf_dir, "documents"), op1_sharding.QUERY_LIMIT)


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.mix(_t(spark, sf_dir, "documents"))


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_substring.remove_repeats(_t(spark, sf_dir, "documents"))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return op4_quality.score(docs, op4_quality.fit(docs, _t(spark, sf_dir, "labels")))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_rules.judge(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op6_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_minhash.near_duplicates(_t(spark, sf_dir, "documents"), k=2, percent=80).drop("n_links")


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return op7_pii.find(docs, op7_pii.fit(docs))


def op8_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_sentencepiece.encode(_t(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_warc.derivatives(_t(spark, sf_dir, "pages"))


def op10_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of ascending doc_id against one index, which goes when all rows are decided."""
    index = op10_exact_dedup.DigestIndex(spark)
    out = index.decide(_t(spark, sf_dir, "documents"), batches=4)
    index.drop()
    return out


def op11_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_funnels.funnels(_t(spark, sf_dir, "clicks"))


def op12_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(_t(spark, sf_dir, "embeddings"))


def op13_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_chat.digests(op13_chat.format_chats(op13_chat.with_trap(_t(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_extendible_sharding, op2_pivotal_mixing, op3_suffix_trees, op4_attention_mil, op5_decision_list, op6_bayes_minhash, op7_skip_chain_pii, op8_sentencepiece_wfst, op9_warc_derivatives, op10_digest_index, op11_ordered_funnels, op12_residue_whitening, op13_chat_templates)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_sharding": op1_sharding.ORACLE, "op3_suffix_trees": op3_substring.ORACLE, "op6_bayes_minhash": op6_minhash.ORACLE, "op10_digest_index": op10_exact_dedup.ORACLE, "op11_ordered_funnels": op11_funnels.ORACLE, "op13_chat_templates": op13_chat.ORACLE}
