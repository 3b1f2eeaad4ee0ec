"""The registered queries of this subpackage, one opN_ per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from grainery.llm import common, jaccard_join, langid, neighbours, packing, pii, quality_rules, rule_ensemble, sql_bpe, token_counts, token_files

GPT_JSON = "byte_bpe_50k.json"

#: The key of the registered query; a deployment passes its own.
PII_KEY = "a key for tests only"


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(common.table(spark, sf_dir, "documents"), policy="v2")


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"), PII_KEY)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(GPT_JSON), limit=512)


def op4_sql_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_bpe.encode_and_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_multiprobe_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(common.table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(GPT_JSON), end_id=0, window=1024)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_digest(common.table(spark, sf_dir, "documents"), public_tokenizers.path(GPT_JSON), end_id=2)


def op7_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects alone, from the ledger of the whole corpus."""
    return quality_rules.ablations(quality_rules.ledger(common.table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_rule_ledger, op2_feistel_pseudonyms, op3_token_counts, op4_sql_bpe, op5_multiprobe_hashing, op6_mixture_packing, op7_language_mixtures, op8_jaccard_join, op9_rule_ensemble, op10_token_files, rule_ablations)}

ORACLE_SQL: dict[str, str] = {"op1_rule_ledger": quality_rules.ORACLE_SQL, "rule_ablations": quality_rules.ABLATIONS_SQL, "op8_jaccard_join": jaccard_join.ORACLE_SQL}
