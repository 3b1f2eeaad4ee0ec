"""Per-document JSON metadata and the gate that it puts before writing chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainery.functions import text as X

CHAPTERS = "array<struct<title:string,start:double,end:double>>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def load(c: Column | str) -> Column:
    """The JSON object in a string, or `{}` for anything else."""
    return F.when(is_object(c), _c(c)).otherwise(F.lit("{}"))


def is_object(c: Column | str) -> Column:
    shape = F.schema_of_variant(F.try_parse_json(_c(c)))
    return F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False))


def dumps(fields: Column | str) -> Column:
    """JSON of a struct or map; null if it has nothing in it."""
    text = F.to_json(_c(fields))
    return F.when(text != "{}", text)


def author(c: Column | str) -> Column:
    return F.coalesce(F.get_json_object(load(c), "$.author"), F.lit(""))


def chapters(c: Column | str, source_type: Column | str) -> Column:
    """Three-valued: null if never recorded, empty if none were published, else the chapters; null for other sources."""
    read = F.from_json(load(c), f"struct<video:struct<chapters:{CHAPTERS}>>")
    return F.when(_c(source_type) == "transcript", read["video"]["chapters"])


def chapters_error(c: Column | str, source_type: Column | str) -> Column:
    """Why a transcript cannot be chunked yet; null if it can."""
    missing = (_c(source_type) == "transcript") & chapters(c, source_type).isNull()
    return F.when(missing, F.lit("chapters were never recorded for this transcript"))


def gate(c: Column | str, source_type: Column | str, chapters_used: Column | str) -> Column:
    """Why a document's chunks may not be written; null if they may."""
    unused = F.size(chapters(c, source_type)) > 0
    return F.coalesce(chapters_error(c, source_type), F.when(unused & ~F.coalesce(_c(chapters_used), F.lit(False)), F.lit("this transcript has chapters and the chunks do not use them")))


def from_video(channel: Column, video_id: Column, duration: Column, found: Column, error: Column) -> Column:
    """The metadata of a captured video: a blank author and, after an error, the chapters are left out."""
    video = F.struct(video_id.alias("video_id"), X.format_duration(duration).alias("duration"), F.when(X.blank(error), found).alias("chapters"))
    return F.to_json(F.struct(X.filled(channel).alias("author"), video.alias("video")))
