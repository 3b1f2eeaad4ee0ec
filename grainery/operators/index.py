"""The keyword index: postings, document lengths and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainery.functions import text as X


def tokenized(snippets: DataFrame, key: str = "id", content: str = "content", tags: str | None = "tags") -> DataFrame:
    """key, tokens of content and tags together."""
    text = F.concat_ws(" ", F.col(content), F.col(tags)) if tags else F.coalesce(F.col(content), F.lit(""))
    return snippets.select(F.col(key).alias("id"), X.tokens(text).alias("tokens"))


def postings(rows: DataFrame) -> DataFrame:
    """term, id, tf of rows(id, tokens)."""
    return rows.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def frequencies(found: DataFrame) -> DataFrame:
    """term, df, total occurrences."""
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def statistics(rows: DataFrame) -> DataFrame:
    """One row: the number of rows and their mean length."""
    return rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def write(found: DataFrame, path: str) -> None:
    """Postings sorted by term, so that a term's files and row groups are found by their least and greatest values."""
    found.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(path)


def refresh(found: DataFrame, changed: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings after the rows with changed ids were written anew (or removed)."""
    ids = changed.select("id").distinct()
    return found.join(ids, "id", "left_anti").unionByName(postings(rows.join(ids, "id", "left_semi")).select(*found.columns))
