"""Grades of proposed headings: structural checks, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainery.functions import segmentation as S
from grainery.operators import store
from grainery.operators.chunking import _explode


def check_points(docs: DataFrame, points: Column, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """The structural flags of each document's array of (before_unit, anchor, heading)."""

    def work(text, kind, points):
        units = S.units_of(text or "", kind)
        found = S.check_points(units, [S.Point(int(p["before_unit"]), p["heading"], 2, p["anchor"] or "") for p in points or []])
        return [tuple(found.values())]

    fields = "n_points int, anchor_ok_rate double, range_ok boolean, no_dup boolean, length_ok boolean, section_cap_ok boolean, hard_fail boolean"
    return _explode(docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind, "points": points}, fields, work)


def judge_sections(docs: DataFrame, points: Column, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """before_unit, heading and body of each inserted section that has units."""

    def work(text, kind, points):
        units = S.units_of(text or "", kind)
        return S.judge_sections(units, [S.Point(int(p["before_unit"]), p["heading"]) for p in points or []])

    return _explode(docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind, "points": points}, "before_unit int, heading string, body string", work)


def with_headings(verdicts: DataFrame, points: DataFrame, key: str = "doc_id") -> DataFrame:
    """Verdicts with their points' headings; the last point at a unit counts, '' where there is none."""
    last = points.groupBy(key, "before_unit").agg(F.max_by("heading", "position").alias("heading"))
    return verdicts.join(last, [key, "before_unit"], "left").withColumn("heading", F.coalesce("heading", F.lit("")))


def mean_scores(verdicts: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Mean score of each document and, with a null key, over all headings; scores that are no numbers are skipped."""
    number = F.col(score).try_cast("double") if dict(verdicts.dtypes)[score] == "string" else F.col(score).cast("double")
    rows = verdicts.select(key, number.alias("number"))
    return rows.rollup(key).agg(F.avg("number").alias("mean_score"), F.count("number").alias("n_scored"))


def score_table(verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """Markdown rows of verdicts."""
    return verdicts.select("*", store.markdown_table(verdicts, columns).alias("line"))


def graded(docs: DataFrame, points: Column, judge, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """A judge's verdict on each inserted section that has units, with its heading; a document without any is not sent."""

    def work(text, kind, points):
        units = S.units_of(text or "", kind)
        sections = S.judge_sections(units, [S.Point(int(p["before_unit"]), p["heading"]) for p in points or []])
        titles = {where: heading for where, heading, _ in sections}
        found = judge.grade(sections) if sections else []
        return [(v["before_unit"], titles.get(v["before_unit"], ""), v["score"], v["grade"], v["reasoning"], v["excerpt"]) for v in found]

    fields = "before_unit int, heading string, score double, grade string, reasoning string, excerpt string"
    return _explode(docs, key, {"text": F.col(text), "kind": F.lit("article") if kind is None else kind, "points": points}, fields, work)


def score_run(docs: DataFrame, points: Column, judge, key: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """One row for each document of a run: its structural flags, mean score, number of scores, and its section of the report."""
    flags = check_points(docs, points, key, text, kind)
    verdicts = graded(docs, points, judge, key, text, kind)
    means = verdicts.groupBy(key).agg(F.avg("score").alias("doc_average"), F.count("score").alias("n_scored"))
    lines = score_table(verdicts, ["before_unit", "heading", "score", "grade", "reasoning"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("before_unit", "line"))).alias("rows"))
    one = flags.join(means, key, "left").join(lines, key, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    name = F.col(key).cast("string")
    table = F.concat(F.lit("| unit | heading | score | grade | reasoning |\n|---|---|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    average = F.concat(F.lit("mean score: "), F.coalesce(F.format_string("%.1f", "doc_average"), F.lit("n/a")))
    about = F.concat(F.col("n_points").cast("string"), F.lit(" headings, hard_fail: "), F.col("hard_fail").cast("string"))
    section = F.concat_ws("\n\n", F.concat(F.lit("## "), name), about, F.when(F.col("rows").isNotNull(), F.concat_ws("\n\n", table, average)).otherwise(F.lit("nothing to grade")))
    return one.select(key, "n_points", "anchor_ok_rate", "range_ok", "no_dup", "length_ok", "section_cap_ok", "hard_fail", "doc_average", "n_scored", section.alias("section"))


def report(scored: DataFrame, run: str, key: str = "doc_id") -> DataFrame:
    """A run's report, a row for each part (part 0 is the head, the last one the summary): append it with `files.write_texts`, in order of part."""
    total = scored.agg(F.count("*").alias("n"), F.sum("n_scored").alias("k"), F.sum(F.col("doc_average") * F.col("n_scored")).alias("s"))
    mean = F.coalesce(F.format_string("%.1f", F.col("s") / F.nullif("k", F.lit(0))), F.lit("n/a"))
    summary = F.concat(F.lit("## Summary\n\nmean score: "), mean, F.lit("\n"), F.coalesce("k", F.lit(0)).cast("string"), F.lit(" headings graded in "), F.col("n").cast("string"), F.lit(" documents"))
    head = scored.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(scored.schema[key].dataType).alias(key), F.lit(f"# Run {run}").alias("text"))
    return head.union(scored.select(F.lit(1), key, "section")).union(total.select(F.lit(2), F.lit(None).cast(scored.schema[key].dataType), summary))
