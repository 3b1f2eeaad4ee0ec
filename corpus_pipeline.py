"""A corpus pipeline: rules, classifier, near duplicates, privacy, packing.

Each stage takes the documents that its predecessor kept, written as Parquet
and read again, and returns documents with the same columns; the last returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainery.llm import common, jaccard_join, packing, pii, quality_rules, rule_ensemble
from grainery.llm.queries import GPT_JSON, PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules' policy."""
    return quality_rules.select_passing(docs, "v2")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to what is left of the labelled ones, predicts to be good."""
    model = rule_ensemble.fit(docs, common.table(spark, sf_dir, "labels"))
    return rule_ensemble.select_good(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates, one row for each id: of an id's rows the one of least text.

    Rows without an id cannot be told apart: those in a group without any id all stay.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "component_id")
    heads = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    heads = common.materialize(heads.select(F.col("doc_id").alias("head"), "n"), "pipeline-heads")
    small = heads.count() * 16 <= common.BROADCAST_BYTES
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(F.broadcast(heads) if small else heads, F.col("row.doc_id").eqNullSafe(F.col("head")))
    if heads.filter("head IS NOT NULL AND n > 1").isEmpty():
        return kept.select("row.*")
    alone = F.col("head").isNull() | (F.col("n") == 1)
    first = kept.filter(~alone).groupBy("head").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row"))
    return kept.filter(alone).select("row.*").union(first.select("row.*"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms."""
    out = pii.pseudonymize(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path(GPT_JSON), end_id=0, window=1024)


STAGES = [("quality rules", quality), ("quality classifier", classifier), ("n-gram Jaccard join", deduplicate), ("PII", privacy), ("packing", pack)]

#: SQL can't express the classifier's fit nor the tokenizer; tests/llm holds each stage against a plain-Python reading of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each one's result written and read again; what a stage has read is deleted after it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
