"""Chunking of whole corpora: map-only operators over documents."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainery.functions import segmentation as S
from grainery.operators import metadata

UNIT_FIELDS = "unit_index int, start int, end int, text string, stamp string"
CHUNK_FIELDS = "chunk_index int, prefix string, content string, chars int, over_cap boolean, start string, end string, body_start int, body_end int"
SUMMARY_FIELDS = "ok boolean, error string, backend string, headings_inserted int, chapters_used boolean, chapters_error string, message string, structured_text string"


def _explode(docs: DataFrame, key: str, arguments: dict[str, Column], fields: str, work: Callable[..., list[tuple]]) -> DataFrame:
    """Rows (key, *fields) of work(**arguments) for each document, batch by batch."""
    rows = docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in arguments.items()))
    kind = rows.schema["key"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], fields).schema
    names, given = [f.name for f in schema.fields], list(arguments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [work(**r) for r in part.select(given).to_pylist()]
                owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                flat = [row for f in found for row in f]
                columns = [pa.array([row[j] for row in flat], t) for j, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("key").take(owner), *columns], names=[key, *names])

    return rows.mapInArrow(run, f"{key} {kind}, {fields}")


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """The units of every document; kind is a column, articles by default."""
    return _explode(
        docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind}, UNIT_FIELDS,
        lambda text, kind: [(u.index, u.start, u.end, u.text, u.stamp) for u in S.units_of(text or "", kind)],
    )


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence units of every document."""
    return _explode(
        docs, key, {"text": F.col(text)}, "unit_index int, start int, end int, text string",
        lambda text: [(i, a, b, text[a:b]) for i, (a, b) in enumerate(S.sentence_spans(text or "", 0, len(text or "")))],
    )


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """Sections at the documents' own headings, with their paths."""

    def work(text, kind):
        found = S.units_of(text or "", kind)
        return [(i, list(s.path), s.first, s.last, found[s.first].start, found[s.last].end) for i, s in enumerate(S.sections_of(found))]

    return _explode(docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind}, "section_index int, path array<string>, first_unit int, last_unit int, start int, end int", work)


def _chunking(text, kind, title, channel, chapters, provider, name) -> S.Chunking:
    listed = [dict(c) for c in chapters] if chapters is not None else None
    return S.chunk_text(text, kind, title or "", channel or "", listed, provider, name)


def _inputs(docs: DataFrame, text: str, kind: Column | None, title: Column | None, channel: Column | None, chapters: Column | None) -> dict[str, Column]:
    none = F.lit(None).cast("array<struct<title:string,start:double,end:double>>")
    return {
        "text": F.col(text), "kind": F.lit("article") if kind is None else kind, "title": F.lit("") if title is None else title,
        "channel": F.lit("") if channel is None else channel, "chapters": none if chapters is None else chapters,
    }


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None, title: Column | None = None, channel: Column | None = None, chapters: Column | None = None, provider: S.HeadingProvider | None = None, name: str = "provider") -> DataFrame:
    """The chunks of every document; a provider proposes headings, none by default."""
    work = functools.partial(_chunk_rows, provider=provider, name=name)
    return _explode(docs, key, _inputs(docs, text, kind, title, channel, chapters), CHUNK_FIELDS, work)


def _chunk_rows(provider, name, **inputs) -> list[tuple]:
    return [tuple(c) for c in _chunking(**inputs, provider=provider, name=name).chunks]


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None, title: Column | None = None, channel: Column | None = None, chapters: Column | None = None, provider: S.HeadingProvider | None = None, name: str = "provider") -> DataFrame:
    """How chunking went, one row per document, with the text that has its headings inserted."""
    work = functools.partial(_summary_row, provider=provider, name=name)
    return _explode(docs, key, _inputs(docs, text, kind, title, channel, chapters), SUMMARY_FIELDS, work)


def _summary_row(provider, name, **inputs) -> list[tuple]:
    c = _chunking(**inputs, provider=provider, name=name)
    return [(c.ok, c.error, c.backend, c.headings_inserted, c.chapters_used, c.chapters_error, c.message, c.structured_text)]


def stored(documents: DataFrame, ids: DataFrame | None = None, provider: S.HeadingProvider | None = None, name: str = "provider") -> tuple[DataFrame, DataFrame]:
    """Chunks and summaries, by document_id, of stored documents: of all, or of ids(id).

    Text, title, channel and chapters are the document's own, so no caller can leave them out.
    An unknown id and a transcript whose chapters were never recorded give a summary with an error and no chunks.
    """
    chosen = documents if ids is None else documents.join(ids.select("id").distinct(), "id", "left_semi")
    rows = chosen.select(
        F.col("id").alias("document_id"), "raw_text", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("source_type") == "transcript", "transcript").otherwise("article").alias("kind"),
        metadata.author("source_metadata").alias("channel"), metadata.chapters("source_metadata", "source_type").alias("chapters"), metadata.chapters_error("source_metadata", "source_type").alias("why"),
    )
    ready = rows.filter("why IS NULL")
    given = {"key": "document_id", "text": "raw_text", "kind": F.col("kind"), "title": F.col("title"), "channel": F.col("channel"), "chapters": F.col("chapters"), "provider": provider, "name": name}
    found, sums = chunks(ready, **given), summaries(ready, **given)
    refused = rows.filter("why IS NOT NULL").select("document_id", F.col("why").alias("error"))
    if ids is not None:
        lost = ids.select("id").distinct().join(documents.select("id"), "id", "left_anti")
        refused = refused.union(lost.select(F.col("id").alias("document_id"), F.lit("no such document").alias("error")))
    return found, sums.unionByName(refused.withColumn("ok", F.lit(False)), allowMissingColumns=True)


def front_matter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs of each text's leading block, and where its body starts."""

    def work(text):
        pairs, at = S.front_matter(text or "")
        return [(list(pairs.items()), at)]

    return _explode(docs, key, {"text": F.col(text)}, "pairs map<string,string>, body_start int", work)


def rendered(docs: DataFrame, points: Column | None = None, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """Each document's units as a provider reads them, numbered; with points, as a person does: below headings and their anchors."""

    def work(text, kind, points):
        units = S.units_of(text or "", kind)
        if points is None:
            return [(S.render_units(units),)]
        return [(S.render_with_headings(units, [S.Point(int(p["before_unit"]), p["heading"], 2, p["anchor"] or "") for p in points]),)]

    given = F.lit(None).cast("array<struct<before_unit:int,anchor:string,heading:string>>") if points is None else points
    return _explode(docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind, "points": given}, "rendered string", work)


def prompts(docs: DataFrame, base: str, transcript: str = "", key: str = "doc_id", text: str = "text", kind: Column | None = None, chapters: Column | None = None, feedback: Column | None = None) -> DataFrame:
    """What a heading provider is told about each document: the base, more for transcripts, its chapters, and its last faults."""

    def work(text, kind, chapters, feedback):
        units = S.units_of(text or "", kind)
        spans = S.chapter_spans(units, S.chapter_points(units, [dict(c) for c in chapters or []]))
        return [(S.compose_prompt(base, kind, transcript, S.render_chapters(spans), feedback),)]

    none = F.lit(None).cast("array<struct<title:string,start:double,end:double>>")
    given = {"text": F.col(text), "kind": F.lit("article") if kind is None else kind, "chapters": none if chapters is None else chapters, "feedback": F.lit(None).cast("string") if feedback is None else feedback}
    return _explode(docs, key, given, "prompt string", work)


def points(docs: DataFrame, proposals: Column, key: str = "doc_id", text: str = "text", kind: Column | None = None, level: int = 2) -> DataFrame:
    """Validated points out of an array of (before_unit, anchor, heading), with the messages of each document."""

    def work(text, kind, proposals):
        found = S.units_of(text or "", kind)
        good, message = S.validate(proposals or [], found, level)
        return [(p.before_unit, p.heading, p.level, message) for p in good]

    return _explode(docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind, "proposals": proposals}, "before_unit int, heading string, level int, message string", work)


def chapter_points(docs: DataFrame, chapters: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where published chapters fall in transcripts, with each chapter's span and fault."""

    def work(text, chapters):
        found = S.units_of(text or "", "transcript")
        fixed = S.chapter_points(found, [dict(c) for c in chapters or []])
        return [(s.title, s.first, s.last, s.chars, s.long) for s in S.chapter_spans(found, fixed)]

    return _explode(docs, key, {"text": F.col(text), "chapters": chapters}, "title string, first_unit int, last_unit int, chars int, long boolean", work)


def prefix(kind: Column, title: Column, path: Column, start: Column, end: Column, channel: Column) -> Column:
    """The line that stands before a chunk's body; empty parts vanish with their separators."""
    full = lambda c: F.nullif(c, F.lit(""))
    trail = F.filter(path, lambda p: F.coalesce(p, F.lit("")) != "")
    span = F.when(full(start).isNotNull() & full(end).isNotNull(), F.concat(F.lit("["), start, F.lit("–"), end, F.lit("]")))
    lead = F.when(kind == "transcript", full(F.concat_ws(" ", full(F.concat_ws(" — ", full(title), full(channel))), span))).otherwise(full(title))
    return F.concat_ws(" > ", lead, full(F.array_join(trail, " > ")))


def pack_lengths(lengths: Column, target: int = S.TARGET) -> Column:
    """Greedy sums of an array of lengths; one fold, for arrays of up to some thousands."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("size"))
    step = lambda a, x: F.when((a["size"] > 0) & (a["size"] + x > target), F.struct(F.concat(a["done"], F.array(a["size"])).alias("done"), x.alias("size"))).otherwise(F.struct(a["done"].alias("done"), (a["size"] + x).alias("size")))
    return F.when(F.size(lengths) > 0, F.aggregate(lengths, start, step, lambda a: F.concat(a["done"], F.array(a["size"])))).otherwise(F.array().cast("array<int>"))


def candidate_lines(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One Markdown table row per chunk, for a person to confirm; pipes are escaped."""
    from grainery.functions import text as X

    body = F.when(F.col("prefix") != "", F.expr("substring(content, length(prefix) + 3)")).otherwise(F.col("content"))
    opening = X.escape_cell(F.substring(X.collapse(body), 1, 60))
    line = F.concat_ws(" | ", F.col("chunk_index").cast("string"), F.col("chars").cast("string"), F.when(F.col("over_cap"), "!").otherwise(""), X.escape_cell("prefix"), opening)
    return found.select(key, "chunk_index", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def candidate_table(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The whole Markdown table of each document."""
    head = "| # | chars | ! | prefix | opening |\n|---|---|---|---|---|\n"
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "line")))
    return candidate_lines(found, key).groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("table"))
