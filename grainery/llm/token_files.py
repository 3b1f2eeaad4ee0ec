"""Token-id files: Parquet with list columns, read selectively.

Documents are put in ascending doc_id order (ties by text) by a range shuffle,
encoded once, and written in that order with controlled row groups and pages:
token lists dictionary-encoded, ordered integers delta-encoded (format version
2), page indexes by default. Readers of metadata columns touch no token page, and
a doc_id range skips row groups and pages by their least and greatest values.

Columns of the files: part (file partition), doc_id, before (ids of the part
before this document), n_tokens, source, tokens.

Defined results: a null or empty text is the end id alone; null doc_ids come first;
repeated rows are kept, ordered by text; an empty table gives empty files.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainery.llm import common, tokenizing

#: Bytes of a row group and of a page, and the columns that are delta-encoded.
ROW_GROUP, PAGE, DELTA = 16 << 20, 256 << 10, ("doc_id", "before", "n_tokens", "part")


@common.tidy
def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    enc, part, sofar = tokenizing.encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in common.slices(batch):
            ids, at = tokenizing.with_end(*enc.encode(rows.column("text")), end)
            tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) - 1, part, np.int32)), rows.column("doc_id"), pa.array(sofar + at[:-1]), pa.array(np.diff(at), pa.int64()), rows.column("source"), tokens],
                names=["part", "doc_id", "before", "n_tokens", "source", "tokens"],
            )
            sofar += int(at[-1])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write docs(doc_id, text, source) as token files in ascending doc_id order."""
    common.bound_batches(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", source.alias("source"), "text").withColumn("tie", F.xxhash64("text"))
    keys = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("text"), F.asc_nulls_first("source")).drop("tie")
    coded = ordered.mapInArrow(functools.partial(_encode, path=tokenizer_path, end=end_id), f"part int, doc_id {kind}, before bigint, n_tokens bigint, source string, tokens array<int>")
    options = {"parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}
    coded.write.options(**options | {f"parquet.enable.dictionary#{c}": "false" for c in DELTA}).parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Selected columns of documents first..last; both are pushed down to the scan."""
    files = spark.read.parquet(path)
    if first is not None:
        files = files.filter(F.col("doc_id") >= first)
    if last is not None:
        files = files.filter(F.col("doc_id") <= last)
    return files.select(*(columns or files.columns))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the ids before each part, from the integer columns alone."""
    sums = read(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


@common.tidy
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        at = tokens.offsets.to_numpy().astype(np.int64)
        view = memoryview(np.ascontiguousarray(tokens.values.to_numpy()).view("<u4")).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    common.bound_batches(spark)
    bases, files = common.materialize(part_starts(spark, path), "token-parts"), spark.read.parquet(path)
    small = bases.count() * 16 <= common.BROADCAST_BYTES
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.join(F.broadcast(bases) if small else bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "tokens")
    return rows.mapInArrow(_sums, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write token files (in the shared folder if path is None) and digest them."""
    spark = docs.sparkSession
    path = path or common.new_path(spark, "tokens")
    write(docs, path, tokenizer_path, end_id)
    return digest(spark, path)
