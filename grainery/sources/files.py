"""File sources and sinks: loose texts, captions, transcripts, reports, rejects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainery.sources import providers


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files; a path that matches nothing gives an error row instead of an exception."""
    try:
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error"))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([(path, None, "no such file")], "path string, text string, error string")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows over the cores by a key where the files give less than half as many splits; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    """One line-ended text per row (UTF-8); folders are made as needed. Later writes are appended: the sink of reports."""
    rows.select(F.regexp_replace(F.col(text), r"\n+\z", "").alias("value")).write.mode("append").text(path)


def write_each(rows: DataFrame, path: str, key: str = "video_id", text: str = "text") -> None:
    """Each row's text (UTF-8, line-ended) in files of its own, under a folder named by its key: `path/key=<key>/`."""
    one = rows.select(F.col(key).cast("string").alias("key"), F.regexp_replace(F.col(text), r"\n+\z", "").alias("value"))
    one.write.mode("overwrite").partitionBy("key").text(path)


def read_each(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """key, text of what write_each has written."""
    return spark.read.schema("value string, key string").text(path, wholetext=True).select(F.col("key").alias(key), F.col("value").alias("text"))


def _offsets(lengths: pa.Array, width: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) * width)]).astype(np.int32)


def pack_vectors(c: Column | str) -> Column:
    """Vectors as little-endian 32-bit floats in binary: the buffers as they are, without a step per row; a null component becomes NaN."""

    @F.arrow_udf("binary")
    def to_bytes(vectors: pa.Array) -> pa.Array:
        flat = pc.fill_null(vectors.flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False)
        offsets = _offsets(pc.list_value_length(vectors), 4)
        blobs = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, "<f4"))])
        return pc.if_else(vectors.is_valid(), blobs, None)

    return to_bytes(c)


def unpack_vectors(c: Column | str) -> Column:
    """The inverse; null stays null."""

    @F.arrow_udf("array<float>")
    def to_floats(blobs: pa.Array) -> pa.Array:
        whole = pc.fill_null(blobs, b"").cast(pa.large_binary())
        _, cuts, data = whole.buffers()
        cuts = np.frombuffer(cuts, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        values = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].view("<f4") if data else np.zeros(0, "<f4")
        offsets = _offsets(pc.binary_length(blobs), 1) // 4
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float32()), mask=pc.is_null(blobs))

    return to_floats(c)


def caption_segments(primary: DataFrame, fallback: DataFrame, key: str = "video_id") -> DataFrame:
    """Segments of the first source, and of the second one for videos that the first lacks."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("origin", F.lit("api")).unionByName(rest.withColumn("origin", F.lit("files")))


def embed_rows(rows: DataFrame, provider, column: str = "content", batch: int = providers.BATCH, kind: str = "document") -> DataFrame:
    """rows with embedding and embedding_model from a provider, in requests of `batch` texts; a failed request gives nulls.

    A request that raises, or whose vectors are not one of the right width for each text, has failed.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("embedding", "embedding_model")]
    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["embedding array<float>", "embedding_model string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                found = providers.embedded(provider, part[column].tolist(), kind)
                part["embedding"] = found if found is not None else [None] * len(part)
                part["embedding_model"] = provider.model if found is not None else None
                yield part

    return rows.select(*(f"`{f.name}`" for f in kept)).mapInPandas(run, spec)
