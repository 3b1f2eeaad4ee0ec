"""Streaming capture: new documents as they come, each filled url once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainery import schemas
from grainery.functions import text as X


def valid(stream: DataFrame) -> DataFrame:
    return stream.filter(F.col("source_type").isin(*schemas.SOURCE_TYPES) & ~X.blank("raw_text"))


def distinct_urls(stream: DataFrame, delay: str = "7 days", known: DataFrame | None = None) -> DataFrame:
    """The first row of each url within the watermark; rows without one all pass, under a key of their own.

    Urls of `known` documents (a static table, read as each batch begins) are left out as well.
    """
    rows = valid(stream)
    if known is not None:
        urls = known.filter(F.coalesce("url", F.lit("")) != "").select("url").distinct()
        rows = rows.join(urls, "url", "left_anti").select(*stream.columns)
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("no url: "), F.expr("uuid()")))
    return rows.withColumn("__key", key).withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def start(stream: DataFrame, path: str, checkpoint: str, delay: str = "7 days", known: DataFrame | None = None) -> StreamingQuery:
    """Append captured documents to a folder; the checkpoint makes a restart safe. Takes what is there and ends."""
    return distinct_urls(stream, delay, known).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
