"""Writes as pure functions: current tables and a batch in, new rows and rejects out.

Ids are given densely after the greatest present one, in the batch's order;
numbering a batch is a sort of the batch alone, never of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainery import schemas
from grainery.functions import text as X
from grainery.operators import metadata
from grainery.sources import shared


def split_rejects(batch: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and those with one (columns ok, error)."""
    checked = batch.withColumn("error", error)
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL").withColumn("ok", F.lit(False))


def first_error(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in checks))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __part and __position: the partition of a row in a global order, and its dense place in it from 1.

    No single-task sort: rows are range-partitioned by the order, and each gets its
    partition and its place there. They are written to the shared folder at once, as
    adaptive execution may cut the partitions anew in every run of a plan; counts by
    partition and positions are then read from what was written.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shared.materialize(ordered.withColumn("__place", F.monotonically_increasing_id()), "numbered")  # the partition above 33 bits of place
    placed = placed.withColumn("__part", F.shiftright("__place", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = placed.join(F.broadcast(before), "__part")  # one row for each partition of the shuffle
    return numbered.withColumn("__position", F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__place", "__before")


def number(rows: DataFrame, table: DataFrame, order: list[str]) -> DataFrame:
    """Give ids after the table's greatest one, in the order given."""
    greatest = table.agg(F.max("id")).first()[0] or 0
    return positions(rows, order).withColumn("id", F.lit(int(greatest)) + F.col("__position")).drop("__part", "__position")


def capture(batch: DataFrame, documents: DataFrame, order: str = "arrival") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New documents, duplicates (with the id they repeat), and rejects.

    A filled url that is known, or came earlier in the batch, is a duplicate; a null or empty one never is.
    `order` holds a different value in each row. A url's first row comes from a partial
    aggregation and is found again by its place, so that a url of very many rows is no hot task.
    """
    error = first_error(
        (~F.coalesce(F.col("source_type").isin(*schemas.SOURCE_TYPES), F.lit(False)), "unknown source_type"), (X.blank("raw_text"), "empty text")
    )
    good, rejects = split_rejects(batch, error)
    key = F.nullif(F.col("url"), F.lit(""))
    known = documents.filter(F.coalesce("url", F.lit("")) != "").groupBy(F.col("url").alias("__url")).agg(F.min("id").alias("__known"))
    seen = good.join(known, key == F.col("__url"), "left").drop("__url")
    linked = seen.filter(key.isNotNull())
    first = linked.filter("__known IS NULL").groupBy("url").agg(F.min(order).alias(order)).select(order)
    fresh = linked.join(first, order, "left_semi").drop("__known").unionByName(seen.filter(key.isNull()).drop("__known"))
    added = number(fresh, documents, [order])
    named = added.filter(key.isNotNull()).select(F.col("url").alias("__url"), F.col("id").alias("__new"))
    again = linked.join(first, order, "left_anti").join(named, F.col("url") == F.col("__url"), "left")
    duplicates = again.select(order, "url", F.coalesce("__known", "__new").alias("document_id"), F.lit(True).alias("duplicate"))
    return schemas.migrate(added.drop(order), "documents"), duplicates, rejects


def _update(table: DataFrame, changes: DataFrame, column: str, error: Column) -> tuple[DataFrame, DataFrame]:
    """Set one column of rows by id (the last change counts); changes of unknown rows are rejected."""
    good, rejects = split_rejects(changes, error)
    last = good.groupBy("id").agg(F.max_by("value", "position").alias("__value"))
    missing = good.join(table.select("id"), "id", "left_anti").withColumn("error", F.lit("no such row")).withColumn("ok", F.lit(False))
    return table.join(last, "id", "left").withColumn(column, F.coalesce("__value", column)).select(*table.columns), rejects.unionByName(missing)


def affected(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row: how many rows an update has given another value of a column."""
    both = before.select("id", F.col(column).alias("__old")).join(after.select("id", column), "id")
    return both.agg(F.count(F.when(~F.col("__old").eqNullSafe(F.col(column)), 1)).alias("affected"))


def set_summary(documents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes(id, value, position); blank summaries are rejected."""
    return _update(documents, changes, "agent_summary", first_error((X.blank("value"), "empty summary")))


def set_status(documents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _update(documents, changes, "status", first_error((~F.coalesce(F.col("value").isin(*schemas.STATUSES), F.lit(False)), "unknown status")))


def discard(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark documents as discarded; their text stays."""
    return set_status(documents, ids.select("id", F.lit("discarded").alias("value"), F.lit(0).alias("position")))


def write_snippets(batch: DataFrame, documents: DataFrame, snippets: DataFrame, embed=None, order: str = "position") -> tuple[DataFrame, DataFrame]:
    """New snippets of batch(document_id, content, kind, chunk_index, tags, created_at, position).

    Validation and the check of the document come before embedding; an
    embedding that fails leaves a null vector and the row is still written.
    Syntheses and rejections have no chunk index.
    """
    good, rejects = split_rejects(batch, first_error((X.blank("content"), "empty content"), (~F.coalesce(F.col("kind").isin(*schemas.SNIPPET_KINDS), F.lit(False)), "unknown kind")))
    known = documents.select(F.col("id").alias("document_id")).distinct()
    lost = good.join(known, "document_id", "left_anti").withColumn("error", F.lit("no such document")).withColumn("ok", F.lit(False))
    found = good.join(known, "document_id", "left_semi").withColumn("chunk_index", F.when(F.col("kind") == "excerpt", F.col("chunk_index")))
    found = number(found, snippets, [order]).drop(order)
    if embed is not None:
        found = embed(found)
    return schemas.migrate(found, "snippets").select(*schemas.SNIPPETS.fieldNames()), rejects.unionByName(lost)


def excerpt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kind", F.lit("excerpt"))


def synthesis(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kind", F.lit("synthesis")).withColumn("chunk_index", F.lit(None).cast("int"))


def rejection(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.withColumnRenamed(reason, "content").withColumn("kind", F.lit("rejection")).withColumn("chunk_index", F.lit(None).cast("int"))


def write_chunks(chunks: DataFrame, summaries: DataFrame, documents: DataFrame, snippets: DataFrame, created_at: Column, tags: Column | None = None, embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All chunks of documents that pass the gate: new snippets, counts per document, and refused documents.

    chunks and summaries are keyed by document_id, as chunking gives them.
    """
    checked = documents.select(F.col("id").alias("document_id"), "source_type", "source_metadata").join(summaries.select("document_id", "ok", "chapters_used", F.col("error").alias("why")), "document_id")
    error = F.coalesce(F.when(~F.col("ok"), F.coalesce("why", F.lit("chunking failed"))), metadata.gate("source_metadata", "source_type", "chapters_used"))
    judged = checked.select("document_id", error.alias("error"))
    rows = chunks.join(judged.filter("error IS NULL"), "document_id", "left_semi").select(
        "document_id", "content", F.lit("excerpt").alias("kind"), "chunk_index", (F.lit(None).cast("string") if tags is None else tags).alias("tags"), created_at.alias("created_at"),
        F.struct("document_id", "chunk_index").alias("position"),
    )
    written, _ = write_snippets(rows, documents, snippets, embed)
    counts = written.groupBy("document_id").agg(F.count("*").alias("written"), F.count("embedding").alias("embedded"))
    return written, counts, judged.filter("error IS NOT NULL")


def stale(snippets: DataFrame, model: str, document_id: int | None = None) -> DataFrame:
    """Snippets without a vector or with one of another model (null-safe), by id."""
    rows = snippets if document_id is None else snippets.filter(F.col("document_id") == document_id)
    return rows.filter(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))


def reembed(snippets: DataFrame, model: str, embed, document_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Snippets with stale vectors replaced, and the counts (selected, embedded, skipped)."""
    chosen = stale(snippets, model, document_id)
    fresh = embed(chosen.drop("embedding", "embedding_model")).select("id", F.col("embedding").alias("__e"), F.col("embedding_model").alias("__m"))
    merged = snippets.join(fresh, "id", "left")
    table = merged.withColumn("embedding", F.coalesce("__e", "embedding")).withColumn("embedding_model", F.coalesce("__m", "embedding_model")).select(*snippets.columns)
    scope = snippets if document_id is None else snippets.filter(F.col("document_id") == document_id)
    need = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))
    before = scope.agg(F.count("*").alias("total"), F.count(F.when(need, 1)).alias("selected"))
    done = fresh.agg(F.count("__e").alias("embedded"))
    return table, before.crossJoin(done).select("selected", "embedded", (F.col("total") - F.col("selected")).alias("skipped"))  # one row each


def markdown_table(rows: DataFrame, columns: list[str]) -> Column:
    """A Markdown row of columns; line ends become spaces and numbers of type double get one decimal."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.format_string("%.1f", F.col(c)) if kinds[c] == "double" else F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*\n\s*", " ")
    return F.concat(F.lit("| "), reduce(lambda a, b: F.concat(a, F.lit(" | "), b), [cell(c) for c in columns]), F.lit(" |"))
