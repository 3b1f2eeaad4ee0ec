"""Queries over headings, chapters, fences and grades, with their SQL twins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainery.functions import segmentation as S
from grainery.functions import text as X
from grainery.operators import chunking, evaluation
from grainery.plans.catalogue import _HEADED, _PIECES, _SENTENCES, _TALK, _headed, _table, _talks, query
from grainery.sources import providers


@dataclass(frozen=True)
class EveryTenth:
    """A heading before every tenth unit."""

    def __call__(self, units: Sequence[S.Unit], kind: str, feedback: str | None, spans: Sequence[S.ChapterSpan]) -> list:
        return [{"before_unit": u.index, "heading": f"Part {u.index // 10}", "anchor": ""} for u in units[::10]]


@dataclass(frozen=True)
class Silent:
    """No headings at all."""

    def __call__(self, units: Sequence[S.Unit], kind: str, feedback: str | None, spans: Sequence[S.ChapterSpan]) -> list:
        return []


def _points(*points: tuple[Column, str, str]) -> Column:
    """An array of (before_unit, anchor, heading)."""
    return F.array(*(F.struct(where.alias("before_unit"), F.lit(anchor).alias("anchor"), F.lit(heading).alias("heading")) for where, anchor, heading in points))


#: The limits of sections in `cuts(key, a)` (a: a first unit), as messages about those over the cap.
_OVER = """
ends AS (SELECT {key}, count(*) AS n FROM {units} GROUP BY {key}),
limits AS (SELECT DISTINCT {key}, a FROM (SELECT {key}, 0 AS a FROM ends UNION ALL SELECT {key}, n FROM ends UNION ALL SELECT {key}, a FROM cuts)),
spans AS (SELECT {key}, a, lead(a) OVER (PARTITION BY {key} ORDER BY a) - 1 AS b FROM limits),
over AS (
  SELECT s.{key}, string_agg(format('section from unit {{}} to {{}} has {{:,}} characters, over 7,000', s.a, s.b, y.end_pos - x.start_pos), '; ' ORDER BY s.a) AS why
  FROM spans s JOIN {units} x ON x.{key} = s.{key} AND x.unit_index = s.a JOIN {units} y ON y.{key} = s.{key} AND y.unit_index = s.b
  WHERE y.end_pos - x.start_pos > 7000 GROUP BY s.{key})
"""


@query(f"""
WITH {_SENTENCES}, cuts AS (SELECT doc_id, 10 AS a FROM units GROUP BY doc_id HAVING count(*) >= 10), {_OVER.format(key="doc_id", units="units")},
m AS (
  SELECT doc_id, n, concat_ws('; ', 'malformed point {{''before_unit'': ''x'', ''anchor'': '''', ''heading'': ''A''}}', CASE WHEN n < 10 THEN 'unit 10 is outside 0..' || n END, 'empty heading before unit 0',
    'heading before unit 1 has over 80 characters', 'second heading before unit 0', why) AS message
  FROM ends LEFT JOIN over USING (doc_id))
SELECT doc_id, 0 AS before_unit, 'Start' AS heading, 2 AS level, message FROM m
UNION ALL SELECT doc_id, 10, 'Ten', 2, message FROM m WHERE n >= 10
""")
def point_messages(spark, sf_dir):
    given = _points(*((F.lit(w), "", h) for w, h in (("x", "A"), ("10", "Ten"), ("0", " # "), ("0", "## Start"), ("0", "Again"), ("1", "y" * 81))))
    return chunking.points(_table(spark, sf_dir, "documents"), given)


@query(rf"""
WITH {_SENTENCES}, cuts AS (SELECT doc_id, unit_index AS a FROM units WHERE unit_index % 10 = 0), {_OVER.format(key="doc_id", units="units")},
g AS (SELECT u.*, d.text, coalesce(lag(end_pos) OVER (PARTITION BY u.doc_id ORDER BY unit_index), start_pos) AS done FROM units u JOIN documents d USING (doc_id)),
inserted AS (
  SELECT doc_id, unit_index, text[done + 1:start_pos] || CASE WHEN unit_index % 10 <> 0 THEN '' ELSE
    CASE WHEN unit_index = 0 OR (start_pos > 1 AND text[start_pos - 1:start_pos] = chr(10) || chr(10)) THEN '' WHEN text[start_pos:start_pos] = chr(10) THEN chr(10) ELSE chr(10) || chr(10) END
    || '## Part ' || (unit_index // 10) || chr(10) || chr(10) END || unit_text AS piece
  FROM g)
SELECT doc_id, TRUE AS ok, 'tenth' AS backend, ((max(n) + 9) // 10)::INT AS headings_inserted, any_value(why) AS message, string_agg(piece, '' ORDER BY unit_index) AS structured_text
FROM inserted JOIN ends USING (doc_id) LEFT JOIN over USING (doc_id) GROUP BY doc_id
""")
def structured_texts(spark, sf_dir):
    found = chunking.summaries(_table(spark, sf_dir, "documents"), provider=EveryTenth(), name="tenth")
    return found.select("doc_id", "ok", "backend", "headings_inserted", "message", "structured_text")


def _packed(key: str, units: str, begins: str) -> str:
    """Recursive SQL `g`: units packed into chunks that begin anew where `begins` holds."""
    grown = "g.size + u.end_pos - u.start_pos"
    return f"""
g AS (
  SELECT {key}, unit_index, start_pos, end_pos, end_pos - start_pos AS size, 0 AS chunk_index FROM {units} WHERE unit_index = 0
  UNION ALL
  SELECT u.{key}, u.unit_index, u.start_pos, u.end_pos, CASE WHEN {begins} OR {grown} > 1800 THEN u.end_pos - u.start_pos ELSE {grown} END, g.chunk_index + ({begins} OR {grown} > 1800)::INT
  FROM g JOIN {units} u ON u.{key} = g.{key} AND u.unit_index = g.unit_index + 1),
packed AS (SELECT {key}, chunk_index, min(unit_index) AS a, max(unit_index) AS b, min(start_pos) AS body_start, max(end_pos) AS body_end FROM g GROUP BY ALL)
"""


@query(f"""
WITH RECURSIVE {_SENTENCES}, {_packed("doc_id", "units", "u.unit_index % 10 = 0")}
SELECT doc_id, chunk_index, source || ' > Part ' || (a // 10) AS prefix, source || ' > Part ' || (a // 10) || chr(10) || chr(10) || text[body_start + 1:body_end] AS content
FROM packed JOIN documents USING (doc_id)
""")
def provider_chunks(spark, sf_dir):
    found = chunking.chunks(_table(spark, sf_dir, "documents"), title=F.col("source"), provider=EveryTenth())
    return found.select("doc_id", "chunk_index", "prefix", "content")


@query(rf"""
WITH RECURSIVE {_HEADED},
hu AS (
  SELECT doc_id, unit_index, length(regexp_extract(trim(unit_text), '^(#{{1,6}}) +', 1)) AS level, regexp_extract(trim(unit_text), '^#{{1,6}} +(.*)$', 1) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY unit_index) AS k
  FROM units WHERE regexp_matches(trim(unit_text), '^#{{1,6}} +')),
paths AS (
  SELECT doc_id, k, [title] AS path, unit_index FROM hu WHERE k = 1
  UNION ALL
  SELECT hu.doc_id, hu.k, list_concat(paths.path[1:hu.level - 1], [hu.title]), hu.unit_index FROM paths JOIN hu ON hu.doc_id = paths.doc_id AND hu.k = paths.k + 1),
top AS (SELECT doc_id, arg_min(title, unit_index) AS top FROM hu WHERE level = 1 GROUP BY doc_id),
marked AS (SELECT u.doc_id, u.unit_index, u.start_pos, u.end_pos, p.path IS NOT NULL AS begins FROM units u LEFT JOIN paths p ON p.doc_id = u.doc_id AND p.unit_index = u.unit_index),
{_packed("doc_id", "marked", "u.begins")},
placed AS (SELECT k.doc_id, chunk_index, arg_max(p.path, p.unit_index) AS path FROM packed k LEFT JOIN paths p ON p.doc_id = k.doc_id AND p.unit_index <= k.a GROUP BY ALL),
cut AS (SELECT doc_id, chunk_index, CASE WHEN path[1] = top THEN path[2:] ELSE coalesce(path, []) END AS path FROM placed LEFT JOIN top USING (doc_id)),
led AS (SELECT doc_id, chunk_index, array_to_string(list_filter(list_concat([source], path), lambda x: x <> ''), ' > ') AS prefix FROM cut JOIN documents USING (doc_id))
SELECT doc_id, chunk_index, prefix, prefix || chr(10) || chr(10) || h.t[body_start + 1:body_end] AS content FROM led JOIN packed USING (doc_id, chunk_index) JOIN h USING (doc_id)
""")
def headed_chunks(spark, sf_dir):
    found = chunking.chunks(_headed(_table(spark, sf_dir, "documents")), title=F.col("source"))
    return found.select("doc_id", "chunk_index", "prefix", "content")


@query(rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT doc_id, ls[1] || chr(10) AS g1, '```py' || chr(10) || '# x' || chr(10) || coalesce(ls[2], 'none') || chr(10) || '```' || chr(10) AS fence, chr(10) || array_to_string(ls[3:], chr(10)) AS g2 FROM l),
gaps AS (SELECT doc_id, 0 AS at0, g1 AS g FROM t UNION ALL SELECT doc_id, length(g1) + length(fence) + 6, g2 FROM t),
e AS (SELECT doc_id, at0, unnest(regexp_extract_all(g, '{_PIECES}')) AS piece, generate_subscripts(regexp_extract_all(g, '{_PIECES}'), 1) AS k FROM gaps),
o AS (SELECT doc_id, at0 + sum(length(piece)) OVER (PARTITION BY doc_id, at0 ORDER BY k) - length(piece) AS a, piece FROM e),
every AS (SELECT doc_id, a, piece FROM o WHERE regexp_matches(piece, '\S') UNION ALL SELECT doc_id, length(g1), fence FROM t UNION ALL SELECT doc_id, length(g1) + length(fence), '# Head' FROM t)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS unit_index, a::INT AS start_pos, piece AS unit_text FROM every
""")
def fenced_units(spark, sf_dir):
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    text = F.concat(F.get(lines, F.lit(0)), F.lit("\n```py\n# x\n"), F.coalesce(F.get(lines, F.lit(1)), F.lit("none")), F.lit("\n```\n# Head\n"), rest)
    units = chunking.units(_table(spark, sf_dir, "documents").withColumn("text", text))
    return units.select("doc_id", "unit_index", F.col("start").alias("start_pos"), F.col("text").alias("unit_text"))


@query(f"""
WITH {_TALK}
SELECT conv_id, unit_index, 'T' || conv_id AS title, 'y: z' AS x, (25 + length(conv_id::VARCHAR))::INT AS body_start, (25 + length(conv_id::VARCHAR) + end_pos - length(unit_text))::INT AS start_pos FROM placed
""")
def front_matter_units(spark, sf_dir):
    head = F.concat(F.lit("---\ntitle: T"), F.col("conv_id").cast("string"), F.lit("\nx: y: z\n---\n"))
    rows = _talks(spark, sf_dir).withColumn("text", F.concat(head, "text"))
    units = chunking.units(rows, "conv_id", kind=F.lit("transcript")).select("conv_id", "unit_index", F.col("start").alias("start_pos"))
    found = chunking.front_matter(rows, "conv_id").select("conv_id", F.col("pairs")["title"].alias("title"), F.col("pairs")["x"].alias("x"), "body_start")
    return units.join(found, "conv_id")


_CHAPTERS = "array(named_struct('title', 'One', 'start', 0D, 'end', 1D), named_struct('title', 'Two', 'start', 50D, 'end', 1D), named_struct('title', 'Three', 'start', 70D, 'end', 1D), named_struct('title', 'Four', 'start', 100D, 'end', 1D), named_struct('title', 'Five', 'start', 90000D, 'end', 1D))"

_FIRSTS = f"""
{_TALK},
tu AS (SELECT conv_id, unit_index, stamp, (end_pos - length(unit_text))::INT AS start_pos, end_pos, unit_text, seconds FROM placed),
c AS (SELECT * FROM (VALUES (1, 'One', 0), (2, 'Two', 50), (3, 'Three', 70), (4, 'Four', 100), (5, 'Five', 90000)) v(pos, title, start)),
f AS (SELECT conv_id, pos, title, min(unit_index) AS a FROM tu JOIN c ON seconds >= start GROUP BY ALL),
firsts AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, a ORDER BY pos) = 1),
cuts AS (SELECT conv_id, a FROM firsts)
"""


@query(f"""
WITH RECURSIVE {_FIRSTS}, marked AS (SELECT tu.*, firsts.a IS NOT NULL AS begins FROM tu LEFT JOIN firsts ON firsts.conv_id = tu.conv_id AND firsts.a = tu.unit_index),
{_packed("conv_id", "marked", "u.begins")},
named AS (SELECT k.conv_id, chunk_index, k.a, k.b, arg_max(firsts.title, firsts.a) AS title FROM packed k JOIN firsts ON firsts.conv_id = k.conv_id AND firsts.a <= k.a GROUP BY ALL),
whole AS (SELECT conv_id, string_agg(unit_text, '' ORDER BY unit_index) AS t FROM tu GROUP BY conv_id),
led AS (SELECT n.*, 'Talk — Ch [' || x.stamp || '–' || y.stamp || '] > ' || n.title AS prefix FROM named n JOIN tu x ON x.conv_id = n.conv_id AND x.unit_index = n.a JOIN tu y ON y.conv_id = n.conv_id AND y.unit_index = n.b)
SELECT conv_id, chunk_index, prefix, prefix || chr(10) || chr(10) || t[body_start + 1:body_end] AS content FROM led JOIN packed USING (conv_id, chunk_index) JOIN whole USING (conv_id)
""")
def chapter_chunks(spark, sf_dir):
    found = chunking.chunks(_talks(spark, sf_dir), "conv_id", kind=F.lit("transcript"), title=F.lit("Talk"), channel=F.lit("Ch"), chapters=F.expr(_CHAPTERS))
    return found.select("conv_id", "chunk_index", "prefix", "content")


@query(f"""
WITH {_FIRSTS}, {_OVER.format(key="conv_id", units="tu")},
w AS (SELECT conv_id, count(*) AS k, string_agg('chapter ''' || title || ''' lacks a heading at its first unit ' || a, '; ' ORDER BY a) AS why FROM firsts GROUP BY conv_id)
SELECT w.conv_id, 'chapters+silent' AS backend, TRUE AS chapters_used, k::INT AS headings_inserted, concat_ws('; ', over.why, w.why) AS message FROM w LEFT JOIN over USING (conv_id)
""")
def chapter_audit(spark, sf_dir):
    found = chunking.summaries(_talks(spark, sf_dir), "conv_id", kind=F.lit("transcript"), chapters=F.expr(_CHAPTERS), provider=Silent(), name="silent")
    return found.select("conv_id", "backend", "chapters_used", "headings_inserted", "message")


@query(f"""
WITH {_FIRSTS},
n AS (SELECT conv_id, count(*) AS n FROM tu GROUP BY conv_id),
s AS (SELECT conv_id, title, a, coalesce(lead(a) OVER (PARTITION BY conv_id ORDER BY a), n) - 1 AS b FROM firsts JOIN n USING (conv_id)),
z AS (SELECT s.*, y.end_pos - x.start_pos AS size FROM s JOIN tu x ON x.conv_id = s.conv_id AND x.unit_index = s.a JOIN tu y ON y.conv_id = s.conv_id AND y.unit_index = s.b),
r AS (SELECT conv_id, string_agg(format('{{}}: units {{}}-{{}}, {{:,}} characters{{}}', title, a, b, size, CASE WHEN size > 1800 THEN ', long: needs more headings' ELSE '' END), chr(10) ORDER BY a) AS lines FROM z GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10) || chr(10), 'Propose headings.', 'The text is a transcript.', lines, CASE WHEN conv_id % 2 = 0 THEN 'The last answer had these faults: none' END) AS prompt FROM r
""")
def heading_prompts(spark, sf_dir):
    feedback = F.when(F.col("conv_id") % 2 == 0, "none")
    return chunking.prompts(_talks(spark, sf_dir), "Propose headings.", "The text is a transcript.", "conv_id", kind=F.lit("transcript"), chapters=F.expr(_CHAPTERS), feedback=feedback)


@query(f"WITH {_SENTENCES} SELECT doc_id, string_agg('[' || unit_index || '] ' || unit_text, chr(10) || chr(10) ORDER BY unit_index) AS rendered FROM units GROUP BY doc_id")
def rendered_units(spark, sf_dir):
    return chunking.rendered(_table(spark, sf_dir, "documents"))


@query(f"""
WITH {_SENTENCES}
SELECT doc_id, string_agg(CASE WHEN unit_index = 0 THEN '## A' || chr(10) || '<!-- anchor: aa -->' || chr(10) || chr(10) WHEN unit_index = 3 THEN '## C' || chr(10) || '<!-- anchor:  -->' || chr(10) || chr(10) ELSE '' END || unit_text,
  chr(10) || chr(10) ORDER BY unit_index) AS rendered FROM units GROUP BY doc_id
""")
def rendered_points(spark, sf_dir):
    given = _points((F.lit(0), "aa", "A"), (F.lit(3), "bb", "B"), (F.lit(3), "", "C"), (F.lit(10_000_000), "", "D"))
    return chunking.rendered(_table(spark, sf_dir, "documents"), given)


_SECTIONS = f"""
{_SENTENCES},
bodies AS (SELECT doc_id, CASE WHEN unit_index < 3 THEN 0 ELSE 3 END AS before_unit, CASE WHEN unit_index < 3 THEN 'A' ELSE 'C' END AS heading, string_agg(unit_text, ' ' ORDER BY unit_index) AS body FROM units GROUP BY ALL)
"""


def _three() -> Column:
    """Points of which the last one at a unit counts."""
    return _points((F.lit(0), "", "A"), (F.lit(3), "", "B"), (F.lit(3), "", "C"), (F.lit(10_000_000), "", "D"))


@query(f"WITH {_SECTIONS} SELECT doc_id, before_unit, heading, body FROM bodies")
def judged_sections(spark, sf_dir):
    return evaluation.judge_sections(_table(spark, sf_dir, "documents"), _three())


@query(f"WITH {_SECTIONS} SELECT doc_id, before_unit, heading, CASE heading WHEN 'A' THEN 4.0 ELSE 1.5 END::DOUBLE AS score, body[1:60] AS excerpt FROM bodies")
def graded_sections(spark, sf_dir):
    found = evaluation.graded(_table(spark, sf_dir, "documents"), _three(), providers.ScriptedJudge({"A": 4.0, "C": 1.5}))
    return found.select("doc_id", "before_unit", "heading", "score", "excerpt")


@query("""
SELECT doc_id, (doc_id % 4)::INT AS before_unit, quality AS score, CASE doc_id % 4 WHEN 0 THEN 'last' WHEN 1 THEN 'one' ELSE '' END AS heading FROM labels
""")
def verdict_headings(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    verdicts = labels.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("before_unit"), F.col("quality").alias("score"))
    point = lambda where, heading, position: F.struct(F.lit(where).alias("before_unit"), F.lit(heading).alias("heading"), F.lit(position).alias("position"))
    points = labels.select("doc_id", F.explode(F.array(point(0, "first", 0), point(1, "one", 1), point(0, "last", 2))).alias("p")).select("doc_id", "p.*")
    return evaluation.with_headings(verdicts, points)


@query(f"""
WITH {_SENTENCES},
n AS (SELECT doc_id, count(*) AS n, max(end_pos) AS last, min(start_pos) AS first, max(end_pos) FILTER (unit_index = 2) AS e2, max(start_pos) FILTER (unit_index = 3) AS s3 FROM units GROUP BY doc_id),
c AS (SELECT doc_id, n > 3 AS both_, CASE WHEN n > 3 THEN e2 - first <= 7000 AND last - s3 <= 7000 ELSE FALSE END AS good FROM n)
SELECT doc_id, 2 AS n_points, NOT good AS hard_fail, CASE WHEN both_ THEN 2.5 ELSE 4.0 END::DOUBLE AS doc_average, CASE WHEN both_ THEN 2 ELSE 1 END::BIGINT AS n_scored,
  '## ' || doc_id || chr(10) || chr(10) || '2 headings, hard_fail: ' || (NOT good)::VARCHAR || chr(10) || chr(10) || '| unit | heading | score | grade | reasoning |' || chr(10) || '|---|---|---|---|---|' || chr(10) || '| 0 | A | 4.0 | scripted |  |'
  || CASE WHEN both_ THEN chr(10) || '| 3 | B | 1.0 | scripted |  |' ELSE '' END || chr(10) || chr(10) || 'mean score: ' || CASE WHEN both_ THEN '2.5' ELSE '4.0' END AS section
FROM c
""")
def run_scores(spark, sf_dir):
    given = _points((F.lit(0), "no such words", "A"), (F.lit(3), "no such words", "B"))
    found = evaluation.score_run(_table(spark, sf_dir, "documents"), given, providers.ScriptedJudge({"A": 4.0, "B": 1.0}))
    return found.select("doc_id", "n_points", "hard_fail", "doc_average", "n_scored", "section")


@query(r"""
SELECT s_suppkey, concat_ws(',', lower(replace(s_name, '#', '')), 'b-c', 'x_y') AS terms FROM supplier
""")
def search_terms(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    given = F.array(F.concat(F.lit("-"), "s_name", F.lit("_")), F.lit("B-C."), F.lit("--"), F.lit("?!"), F.lit("b-c"), F.lit(" x_Y "), F.replace("s_name", F.lit("#"), F.lit("")))
    return s.select("s_suppkey", F.array_join(X.search_terms(F.lit("not used"), given), ",").alias("terms"))
