"""Captions: WebVTT cues, rolling captions, and transcripts made of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainery.functions import text as X
from grainery.operators import metadata
from grainery.sources import files

SEGMENT = "struct<start:double,duration:double,timestamp:string,text:string>"


def parse_vtt(files: DataFrame, key: str = "video_id", vtt: str = "vtt") -> DataFrame:
    """The cues of WebVTT files in file order: key, position, start, duration, timestamp, text.

    A cue is the lines from a `-->` line to the next blank one; tags go; cues
    without text or with a malformed stamp are skipped. All in the JVM.
    """
    block = F.split(F.regexp_replace(F.col(vtt), r"\r\n?", "\n"), r"\n[ \t]*(?=\n|$)")
    cues = files.select(key, F.posexplode(F.transform(block, lambda b: F.regexp_extract(b, r"(?s)(?:^|\n)([^\n]*-->[^\n]*(?:\n.*)?)$", 1))).alias("position", "cue"))
    cues = cues.filter("cue <> ''").withColumn("head", F.substring_index("cue", "\n", 1))
    ends = F.regexp_extract(F.trim(F.get(F.split("head", "-->"), F.lit(1))), r"^(\S*)", 1)
    lines = F.transform(F.slice(F.split("cue", "\n"), 2, F.greatest(F.size(F.split("cue", "\n")) - 1, F.lit(0))), X.strip_tags)
    read = cues.select(
        key, "position", X.vtt_seconds(F.trim(F.get(F.split("head", "-->"), F.lit(0)))).alias("start"), X.vtt_seconds(ends).alias("stop"),
        F.array_join(F.filter(lines, lambda x: x != ""), " ").alias("text"),
    )
    good = read.filter("text <> '' AND start IS NOT NULL AND stop IS NOT NULL")
    return good.select(key, "position", "start", F.round(F.col("stop") - F.col("start"), 3).alias("duration"), X.format_stamp("start").alias("timestamp"), "text")


def _merge(cues: Iterator[tuple[float, float, str, str]]) -> list[list]:
    kept: list[list] = []
    for start, duration, stamp, text in cues:
        if not text:
            continue
        if kept:
            last = kept[-1]
            reach = round(start + duration - last[0], 3)
            if text in last[3]:
                last[1] = max(reach, last[1])
                continue
            if text.startswith(last[3]):
                last[1], last[3] = reach, text
                continue
        kept.append([start, duration, stamp, text])
    return kept


def dedupe(segments: DataFrame, key: str = "video_id", order: str = "position") -> DataFrame:
    """Rolling captions folded: a cue that repeats or extends the last kept one is merged into it.

    The kept text grows, so each cue is compared with the state after the one
    before it: a fold in order within a video, one video per group.
    """
    kind = segments.schema[key].dataType.simpleString()

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order])
        kept = _merge(frame[["start", "duration", "timestamp", "text"]].itertuples(index=False, name=None))
        return pd.DataFrame({key: frame[key].iloc[0], "segment": range(len(kept)), "start": [k[0] for k in kept], "duration": [k[1] for k in kept], "timestamp": [k[2] for k in kept], "text": [k[3] for k in kept]})

    columns = [key, order, "start", "duration", "timestamp", "text"]
    return segments.select(*columns).groupBy(key).applyInPandas(fold, f"{key} {kind}, segment int, start double, duration double, timestamp string, text string")


def transcripts(segments: DataFrame, key: str = "video_id", order: str = "segment") -> DataFrame:
    """`[stamp] text` lines of each video in order, and their number."""
    line = F.concat(F.lit("["), F.col("timestamp"), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_segments"))


def choose_subtitles(files: DataFrame, key: str = "video_id", path: str = "path") -> DataFrame:
    """Each video's subtitle file with the shortest name, its language, and whether it was generated."""
    name = F.regexp_replace(F.col(path), "^.*/", "")
    best = files.select(key, path, name.alias("name")).groupBy(key).agg(F.min_by(F.struct(path, "name"), F.struct(F.length("name"), "name")).alias("best"))
    language = F.regexp_extract("best.name", r"\.([A-Za-z-]+)\.vtt$", 1)
    return best.select(key, F.col(f"best.{path}").alias(path), language.alias("language"), F.endswith(language, F.lit("-orig")).alias("is_generated"))


def first_json(output: DataFrame, key: str = "video_id", text: str = "output") -> DataFrame:
    """The first line that is a JSON object, of each tool output."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), X.strip), lambda x: F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull())
    return output.select(key, F.get(lines, F.lit(0)).alias("json"))


def video_metadata(output: DataFrame, key: str = "video_id", text: str = "output") -> DataFrame:
    """title, channel (the first filled of four fields) and duration out of a tool's JSON."""
    read = first_json(output, key, text).withColumn("j", F.from_json("json", "title string, channel string, uploader string, creator string, artist string, duration double"))
    names = F.coalesce(*(X.filled(f"j.{n}") for n in ("channel", "uploader", "creator", "artist")))
    return read.select(key, F.coalesce("j.title", F.lit("")).alias("title"), F.coalesce(names, F.lit("")).alias("channel"), F.col("j.duration").alias("duration"))


def video_chapters(output: DataFrame, key: str = "video_id", text: str = "output") -> DataFrame:
    """Published chapters that have a title and a start; an empty array if there are none."""
    read = first_json(output, key, text).withColumn("j", F.from_json("json", "chapters array<struct<title:string,start_time:double,end_time:double>>"))
    good = F.filter("j.chapters", lambda c: ~X.blank(c["title"]) & c["start_time"].isNotNull())
    shaped = F.transform(good, lambda c: F.struct(X.strip(c["title"]).alias("title"), c["start_time"].alias("start"), c["end_time"].alias("end")))
    return read.select(key, F.coalesce(shaped, F.array().cast("array<struct<title:string,start:double,end:double>>")).alias("chapters"))


def captured(primary: DataFrame, fallback: DataFrame, output: DataFrame, key: str = "video_id") -> DataFrame:
    """One row for each video with captions: origin, text, n_segments, title, channel, duration, chapters and the metadata's JSON.

    primary and fallback are segments (key, position, start, duration, timestamp, text); the second one counts for videos that the
    first lacks. output is the tool's JSON (key, output); without a readable one, or for videos that it lacks, title and channel are
    empty, the duration is null, and the metadata holds no chapters, which says that they were never recorded.
    """
    segments = files.caption_segments(primary, fallback, key).withColumn("text", X.collapse("text"))
    origin = segments.groupBy(key).agg(F.first("origin").alias("origin"))  # one value for each video
    texts = transcripts(dedupe(segments, key), key)
    about = video_metadata(output, key).join(video_chapters(output, key), key).join(first_json(output, key), key)
    error = F.when(F.col("json").isNull(), F.lit("no metadata"))
    full = texts.join(origin, key).join(about, key, "left")
    made = metadata.from_video(F.col("channel"), F.col(key).cast("string"), F.col("duration"), F.col("chapters"), error)
    return full.select(key, "origin", "text", "n_segments", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("channel", F.lit("")).alias("channel"), "duration", "chapters", made.alias("source_metadata"))
