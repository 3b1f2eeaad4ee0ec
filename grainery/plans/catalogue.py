"""The catalogue of queries over the reference tables and their SQL twins (DuckDB).

What the tables lack (headings, stamps, chapters, stale vectors and so on) is
derived from them by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainery.functions import text as X
from grainery.operators import captions, chunking, evaluation, index, memory, metadata, search, store
from grainery.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Tables of texts, whose rows are dear, and their keys.
_TEXTS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return files.spread(rows, _TEXTS[name]) if name in _TEXTS else rows


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- segmentation -----------------------------------------------------------

_PIECES = r"(?s).*?(?:[.?!]+(?:\s+|\z)|\z)"

_SENTENCES = rf"""
p AS (SELECT doc_id, regexp_extract_all(text, '{_PIECES}') AS ps FROM documents),
e AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM p),
o AS (SELECT doc_id, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS a FROM e),
units AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS unit_index, a::INT AS start_pos, (a + length(piece))::INT AS end_pos, piece AS unit_text
  FROM o WHERE regexp_matches(piece, '\S'))
"""


def _unit_columns(units: DataFrame, *more: str) -> DataFrame:
    return units.select("doc_id", "unit_index", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("text").alias("unit_text"), *more)


@query(f"WITH {_SENTENCES} SELECT * FROM units")
def sentence_units(spark, sf_dir):
    return _unit_columns(chunking.sentences(_table(spark, sf_dir, "documents")))


@query(rf"""
WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
b AS (SELECT doc_id, list_filter(regexp_extract_all(t, '(?s).*?(?:\n[ \t]*\n+|\z)'), lambda x: x <> '') AS bs FROM t),
bl AS (SELECT doc_id, len(bs) AS n, unnest(bs) AS block, generate_subscripts(bs, 1) AS i FROM b),
bo AS (SELECT *, sum(length(block)) OVER (PARTITION BY doc_id ORDER BY i) - length(block) AS at0 FROM bl),
s AS (SELECT doc_id, i, at0, CASE WHEN n = 1 OR length(block) > 1800 THEN regexp_extract_all(block, '{_PIECES}') ELSE [block] END AS ps FROM bo WHERE regexp_matches(block, '\S')),
e AS (SELECT doc_id, i, at0, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM s),
o AS (SELECT *, at0 + sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY k) - length(piece) AS a FROM e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS unit_index, a::INT AS start_pos, (a + length(piece))::INT AS end_pos, piece AS unit_text
FROM o WHERE regexp_matches(piece, '\S')
""")
def paragraph_units(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _unit_columns(chunking.units(docs))


_HEADED = """
l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i:
  CASE WHEN (i - 1) % 15 = 0 THEN '# ' || x WHEN (i - 1) % 5 = 2 THEN '## ' || x WHEN (i - 1) % 5 = 4 THEN '### ' || x ELSE x END) AS ls FROM documents),
h AS (SELECT doc_id, array_to_string(ls, chr(10)) AS t, ls FROM l),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM h),
y AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS a, i % 15 = 0 OR i % 5 IN (2, 4) AS head FROM x),
heads AS (SELECT doc_id, a, a + length(line) AS b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nx, line FROM y WHERE head),
gaps AS (SELECT heads.doc_id, heads.b AS a, h.t[heads.b + 1:coalesce(heads.nx, length(h.t))] AS g FROM heads JOIN h USING (doc_id)),
pieces AS (SELECT doc_id, a, regexp_extract_all(g, '(?s).*?(?:[.?!]+(?:\\s+|\\z)|\\z)') AS ps FROM gaps),
ex AS (SELECT doc_id, a, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM pieces),
off AS (SELECT doc_id, a + sum(length(piece)) OVER (PARTITION BY doc_id, a ORDER BY k) - length(piece) AS a, piece FROM ex),
both_ AS (SELECT doc_id, a, line AS piece FROM heads UNION ALL SELECT doc_id, a, piece FROM off WHERE regexp_matches(piece, '\\S')),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS unit_index, a::INT AS start_pos, (a + length(piece))::INT AS end_pos, piece AS unit_text FROM both_)
""".replace("\\\\", "\\")


def _headed(docs: DataFrame) -> DataFrame:
    line = lambda x, i: F.when(i % 15 == 0, F.concat(F.lit("# "), x)).when(i % 5 == 2, F.concat(F.lit("## "), x)).when(i % 5 == 4, F.concat(F.lit("### "), x)).otherwise(x)
    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), line), "\n"))


@query(f"WITH {_HEADED} SELECT * FROM units")
def heading_units(spark, sf_dir):
    return _unit_columns(chunking.units(_headed(_table(spark, sf_dir, "documents"))))


@query(rf"""
WITH RECURSIVE {_HEADED},
hu AS (
  SELECT doc_id, unit_index, length(regexp_extract(trim(unit_text), '^(#{{1,6}}) +', 1)) AS level, regexp_extract(trim(unit_text), '^#{{1,6}} +(.*)$', 1) AS title,
    row_number() OVER (PARTITION BY doc_id ORDER BY unit_index) AS k,
    coalesce(lead(unit_index) OVER (PARTITION BY doc_id ORDER BY unit_index), (SELECT max(unit_index) + 1 FROM units u WHERE u.doc_id = units.doc_id)) AS nx
  FROM units WHERE regexp_matches(trim(unit_text), '^#{{1,6}} +')),
paths AS (
  SELECT doc_id, k, [title] AS path, unit_index, nx FROM hu WHERE k = 1
  UNION ALL
  SELECT hu.doc_id, hu.k, list_concat(paths.path[1:hu.level - 1], [hu.title]), hu.unit_index, hu.nx FROM paths JOIN hu ON hu.doc_id = paths.doc_id AND hu.k = paths.k + 1)
SELECT doc_id, (k - 1)::INT AS section_index, array_to_string(path, ' / ') AS path, unit_index AS first_unit, (nx - 1)::INT AS last_unit FROM paths
""")
def heading_paths(spark, sf_dir):
    found = chunking.sections(_headed(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "section_index", F.array_join("path", " / ").alias("path"), "first_unit", "last_unit")


_CHUNKS = f"""
{_SENTENCES},
g AS (
  SELECT doc_id, unit_index, start_pos, end_pos, end_pos - start_pos AS size, 0 AS chunk_index FROM units WHERE unit_index = 0
  UNION ALL
  SELECT u.doc_id, u.unit_index, u.start_pos, u.end_pos,
    CASE WHEN g.size + u.end_pos - u.start_pos > 1800 THEN u.end_pos - u.start_pos ELSE g.size + u.end_pos - u.start_pos END,
    g.chunk_index + (g.size + u.end_pos - u.start_pos > 1800)::INT
  FROM g JOIN units u ON u.doc_id = g.doc_id AND u.unit_index = g.unit_index + 1),
spans AS (SELECT doc_id, chunk_index, min(start_pos) AS body_start, max(end_pos) AS body_end FROM g GROUP BY ALL),
chunks AS (
  SELECT s.doc_id, s.chunk_index, d.source AS prefix, d.source || chr(10) || chr(10) || d.text[s.body_start + 1:s.body_end] AS content, s.body_start, s.body_end
  FROM spans s JOIN documents d USING (doc_id))
"""


def _chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunks(_table(spark, sf_dir, "documents"), title=F.col("source"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, prefix, content, length(content)::INT AS chars, length(content) > 4800 AS over_cap, body_start, body_end FROM chunks")
def packed_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "prefix", "content", "chars", "over_cap", "body_start", "body_end")


@query(f"""
WITH {_SENTENCES},
a AS (SELECT doc_id, list(end_pos - start_pos ORDER BY unit_index) AS ls FROM units GROUP BY doc_id)
SELECT doc_id, array_to_string(list_reduce(list_prepend([0], list_transform(ls, lambda x: [x])),
  lambda acc, x: CASE WHEN acc[len(acc)] > 0 AND acc[len(acc)] + x[1] > 1800 THEN list_concat(acc, x) ELSE list_concat(acc[1:len(acc) - 1], [acc[len(acc)] + x[1]]) END), ',') AS sizes
FROM a
""")
def packed_sizes(spark, sf_dir):
    units = chunking.sentences(_table(spark, sf_dir, "documents"))
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("unit_index", (F.col("end") - F.col("start")).alias("n")))), lambda u: u["n"])
    return units.groupBy("doc_id").agg(lengths.alias("ls")).select("doc_id", F.array_join(chunking.pack_lengths(F.col("ls")).cast("array<string>"), ",").alias("sizes"))


@query(rf"""
WITH RECURSIVE {_CHUNKS}
SELECT doc_id, chunk_index, '| ' || concat_ws(' | ', chunk_index, length(content), CASE WHEN length(content) > 4800 THEN '!' ELSE '' END, replace(prefix, '|', '\|'),
  replace(trim(regexp_replace(content[length(prefix) + 3:], '\s+', ' ', 'g'))[1:60], '|', '\|')) || ' |' AS line
FROM chunks
""")
def candidate_rows(spark, sf_dir):
    return chunking.candidate_lines(_chunks(spark, sf_dir))


@query("""
SELECT doc_id, concat_ws(' > ',
  nullif(CASE WHEN kind = 'transcript' THEN concat_ws(' ', nullif(concat_ws(' — ', title, channel), ''), span) ELSE title END, ''), nullif(path, '')) AS prefix
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'transcript' ELSE 'article' END AS kind, CASE WHEN doc_id % 7 <> 0 THEN source END AS title,
  concat_ws(' > ', lang, CASE WHEN doc_id % 3 <> 0 THEN 'S' || (doc_id % 5) END) AS path,
  CASE WHEN doc_id % 5 <> 0 THEN '[00:01–02:03]' END AS span, CASE WHEN doc_id % 4 <> 0 THEN 'Ch' END AS channel FROM documents)
""")
def chunk_prefix(spark, sf_dir):
    d, n = _table(spark, sf_dir, "documents"), F.col("doc_id")
    part = lambda ok, c: F.when(ok, c).otherwise("")
    made = chunking.prefix(
        F.when(n % 2 == 0, "transcript").otherwise("article"), part(n % 7 != 0, F.col("source")), F.array(F.col("lang"), part(n % 3 != 0, F.concat(F.lit("S"), (n % 5).cast("string")))),
        F.lit("00:01"), part(n % 5 != 0, F.lit("02:03")), part(n % 4 != 0, F.lit("Ch")),
    )
    return d.select("doc_id", made.alias("prefix"))


_TALK = """
turns AS (SELECT conv_id, turn, (turn * 37)::INT AS s, '[' || lpad((turn * 37 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 37 % 60)::VARCHAR, 2, '0') || '] ' || text AS line FROM conversations),
talk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit_index, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
units AS (SELECT conv_id, unit_index::INT AS unit_index, s AS seconds, line[2:6] AS stamp, line || CASE WHEN unit_index < n - 1 THEN chr(10) ELSE '' END AS unit_text FROM talk),
placed AS (SELECT *, sum(length(unit_text)) OVER (PARTITION BY conv_id ORDER BY unit_index)::INT AS end_pos FROM units)
"""


def _talks(spark, sf_dir) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("["), X.format_stamp(F.col("turn") * 37), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


@query(f"WITH {_TALK} SELECT conv_id, unit_index, stamp, seconds, (end_pos - length(unit_text))::INT AS start_pos, end_pos, unit_text FROM placed")
def transcript_units(spark, sf_dir):
    units = chunking.units(_talks(spark, sf_dir), "conv_id", kind=F.lit("transcript"))
    return units.select("conv_id", "unit_index", "stamp", X.stamp_seconds("stamp").alias("seconds"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("text").alias("unit_text"))


@query(f"""
WITH {_TALK},
c AS (SELECT * FROM (VALUES (1, 'One', 0), (2, 'Two', 50), (3, 'Three', 70), (4, 'Four', 100), (5, 'Five', 9000)) v(pos, title, start)),
f AS (SELECT conv_id, pos, title, min(unit_index) AS first_unit FROM placed JOIN c ON seconds >= start GROUP BY ALL),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, first_unit ORDER BY pos) = 1),
e AS (SELECT d.conv_id, title, first_unit, coalesce(lead(first_unit) OVER (PARTITION BY d.conv_id ORDER BY first_unit), t.n) - 1 AS last_unit
  FROM d JOIN (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id) t USING (conv_id))
SELECT e.conv_id, title, first_unit, last_unit::INT AS last_unit, (b.end_pos - a.end_pos + length(a.unit_text))::INT AS chars, b.end_pos - a.end_pos + length(a.unit_text) > 1800 AS long
FROM e JOIN placed a ON a.conv_id = e.conv_id AND a.unit_index = e.first_unit JOIN placed b ON b.conv_id = e.conv_id AND b.unit_index = e.last_unit
""")
def chapter_spans(spark, sf_dir):
    chapters = F.expr("array(named_struct('title', 'One', 'start', 0D), named_struct('title', 'Two', 'start', 50D), named_struct('title', 'Three', 'start', 70D), named_struct('title', 'Four', 'start', 100D), named_struct('title', 'Five', 'start', 9000D), named_struct('title', ' ', 'start', 1D))")
    return chunking.chapter_points(_talks(spark, sf_dir), chapters, "conv_id")


_ANCHOR = r"array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')[1:6], lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_]+', '', 'g'))), lambda w: w <> ''), ' ')"


@query(f"WITH {_SENTENCES} SELECT doc_id, unit_index, {_ANCHOR.format('unit_text')} AS anchor FROM units")
def anchors(spark, sf_dir):
    return chunking.sentences(_table(spark, sf_dir, "documents")).select("doc_id", "unit_index", X.unit_anchor("text").alias("anchor"))


@query(f"""
WITH {_SENTENCES}, a AS (SELECT doc_id, unit_index, {_ANCHOR.format('unit_text')} AS anchor FROM units),
w AS (SELECT doc_id, 2 AS stated, anchor FROM a WHERE unit_index = 5 AND anchor <> ''),
m AS (SELECT w.doc_id, unit_index, stated FROM w JOIN a USING (doc_id) WHERE a.anchor <> '' AND (starts_with(a.anchor, w.anchor) OR starts_with(w.anchor, a.anchor)) AND unit_index BETWEEN stated - 5 AND stated + 5),
r AS (SELECT doc_id, arg_min(unit_index, (abs(unit_index - stated), unit_index)) AS before_unit FROM m GROUP BY doc_id)
SELECT doc_id, before_unit, 'Moved' AS heading FROM r
""")
def anchor_repair(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    given = chunking.sentences(docs).filter("unit_index = 5").select("doc_id", X.unit_anchor("text").alias("anchor")).filter("anchor <> ''")
    proposal = F.array(F.struct(F.lit("2").alias("before_unit"), F.col("anchor"), F.lit("## Moved ").alias("heading")))
    return chunking.points(docs.join(given, "doc_id"), proposal).select("doc_id", "before_unit", "heading")


@query(f"""
WITH {_SENTENCES}, n AS (SELECT doc_id, count(*) AS n, max(end_pos) AS last, min(start_pos) AS first, max(end_pos) FILTER (unit_index = 2) AS e2, max(start_pos) FILTER (unit_index = 3) AS s3 FROM units GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS n_points, 0.0::DOUBLE AS anchor_ok_rate, n > 3 AND doc_id % 4 <> 2 AS range_ok, doc_id % 4 <> 0 AS no_dup, doc_id % 3 <> 0 AS length_ok,
  CASE WHEN n > 3 THEN e2 - first <= 7000 AND last - s3 <= 7000 ELSE last - first <= 7000 END AS section_cap_ok,
  NOT (n > 3 AND doc_id % 2 <> 0 AND doc_id % 3 <> 0 AND e2 - first <= 7000 AND last - s3 <= 7000) AS hard_fail
FROM n
""")
def structural_check(spark, sf_dir):
    n = F.col("doc_id")
    point = lambda at, h: F.struct(at.alias("before_unit"), F.lit("no such words").alias("anchor"), h.alias("heading"))
    two = F.array(point(F.lit(0), F.lit("A")), point(F.lit(3), F.when(n % 3 == 0, F.lit("")).otherwise("B")))
    third = F.when(n % 4 == 0, F.array(point(F.lit(0), F.lit("C")))).when(n % 4 == 2, F.array(point(F.lit(1_000_000), F.lit("C"))))
    return evaluation.check_points(_table(spark, sf_dir, "documents"), F.when(n % 2 == 0, F.concat(two, third)).otherwise(two))


# --- search -----------------------------------------------------------------

_TERMS = ["hetion", "estion", "edtion"]
_NONE_TOGETHER = ["estion", "hetion", "edtion", "ersch", "ndble", "hable"]


def _bm25_sql(terms: list[str], mode: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    tf = ", ".join(f"len(list_filter(tk, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / avgdl))" for i in range(len(terms)))
    hits = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(terms)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    least = {"and": str(len(terms)), "or": "1", "relaxed": f"CASE WHEN full_ > 0 THEN {len(terms)} ELSE 1 END"}[mode]
    return rf"""
tok AS (SELECT {key} AS id, regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+') AS tk FROM {source}),
cnt AS (SELECT id, len(tk) AS length, {tf} FROM tok),
fig AS (SELECT count(*) AS n, avg(length) AS avgdl, count(*) FILTER ({every}) AS full_, {df} FROM cnt),
bm AS (SELECT id, {score} AS score FROM cnt, fig WHERE {hits} >= 1 AND {hits} >= {least})
"""


def _ranked(spark, sf_dir, terms, mode) -> DataFrame:
    rows = index.tokenized(_table(spark, sf_dir, "documents"), "doc_id", "text", None)
    found = search.top(search.bm25(rows, search.query_terms("", terms), mode), 50)
    return found.select("id", "rank", F.round("score", 6).alias("score"))


_TOP50 = "SELECT id, row_number() OVER (ORDER BY bm.score DESC, id)::INT AS rank, round(bm.score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 50"


@query(f"WITH {_bm25_sql(_TERMS[:2], 'and')} {_TOP50}")
def bm25_and(spark, sf_dir):
    return _ranked(spark, sf_dir, _TERMS[:2], "and")


@query(f"WITH {_bm25_sql(_TERMS, 'or')} {_TOP50}")
def bm25_or(spark, sf_dir):
    return _ranked(spark, sf_dir, _TERMS, "or")


@query(f"WITH {_bm25_sql(_NONE_TOGETHER, 'relaxed')} {_TOP50}")
def bm25_relaxed(spark, sf_dir):
    return _ranked(spark, sf_dir, _NONE_TOGETHER, "relaxed")


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM p GROUP BY term
""")
def term_frequencies(spark, sf_dir):
    return index.frequencies(index.postings(index.tokenized(_table(spark, sf_dir, "documents"), "doc_id", "text", None)))


def _vector(spark, sf_dir) -> list[float]:
    row = _table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


_COSINE = """
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q.e) AS score FROM embeddings, q WHERE embedding IS NOT NULL)
"""


@query(f"WITH {_COSINE} SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank, round(score, 6) AS score FROM cs ORDER BY round(score, 9) DESC, id LIMIT 50")
def cosine_topk(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scored = search.cosine_scores(vectors, _vector(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return search.top(scored, 50).select("id", "rank", F.round("score", 6).alias("score"))


_FUSED = f"""
{_bm25_sql(_TERMS, 'relaxed')}, {_COSINE},
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY score DESC, id LIMIT 50),
ve AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM cs ORDER BY round(score, 9) DESC, id LIMIT 50),
fu AS (SELECT id, kw.r AS keyword_rank, ve.r AS vector_rank, coalesce(1.0::DOUBLE / (60 + kw.r), 0) + coalesce(1.0::DOUBLE / (60 + ve.r), 0) AS score FROM kw FULL JOIN ve USING (id)),
best AS (SELECT * FROM fu ORDER BY score DESC, keyword_rank NULLS LAST, vector_rank NULLS LAST LIMIT 10)
"""


def _fused(spark, sf_dir) -> DataFrame:
    rows = index.tokenized(_table(spark, sf_dir, "documents"), "doc_id", "text", None)
    keyword = search.top(search.bm25(rows, search.query_terms("", _TERMS)), 50)
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    meaning = search.top(search.cosine_scores(vectors, _vector(spark, sf_dir)).withColumn("score", F.round("score", 9)), 50)
    return search.fuse(keyword, meaning, 10)


@query(f"WITH {_FUSED} SELECT id, keyword_rank::INT AS keyword_rank, vector_rank::INT AS vector_rank, round(score, 9) AS score FROM best")
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", "keyword_rank", "vector_rank", F.round("score", 9).alias("score"))


@query(f"WITH {_FUSED} SELECT CASE WHEN count(keyword_rank) > 0 AND count(vector_rank) > 0 THEN 'hybrid' WHEN count(keyword_rank) > 0 THEN 'fts_only' WHEN count(vector_rank) > 0 THEN 'vector_only' ELSE 'none' END AS backend FROM best")
def search_backend(spark, sf_dir):
    fused = _fused(spark, sf_dir)
    return search.backend(fused.filter("keyword_rank IS NOT NULL"), fused.filter("vector_rank IS NOT NULL"))


_SNIPPETS = f"""
{_CHUNKS},
snippets AS (SELECT doc_id * 1000 + chunk_index AS id, doc_id AS document_id, content, CASE WHEN chunk_index % 4 = 2 THEN 'synthesis' ELSE 'excerpt' END AS kind, CASE WHEN chunk_index % 4 <> 2 THEN chunk_index END AS chunk_index FROM chunks)
"""


def _snippets(spark, sf_dir) -> DataFrame:
    c = F.col("chunk_index")
    return _chunks(spark, sf_dir).select(
        (F.col("doc_id") * 1000 + c).alias("id"), F.col("doc_id").alias("document_id"), "content", F.when(c % 4 == 2, "synthesis").otherwise("excerpt").alias("kind"),
        F.when(c % 4 != 2, c).alias("chunk_index"), F.lit(None).cast("string").alias("tags"),
    )


@query(f"""
WITH RECURSIVE {_SNIPPETS}
SELECT s.id, s.document_id, s.chunk_index, b.content AS context_before, a.content AS context_after
FROM snippets s LEFT JOIN snippets b ON b.document_id = s.document_id AND b.kind = 'excerpt' AND b.chunk_index = s.chunk_index - 1
LEFT JOIN snippets a ON a.document_id = s.document_id AND a.kind = 'excerpt' AND a.chunk_index = s.chunk_index + 1
""")
def neighbour_expansion(spark, sf_dir):
    rows = _snippets(spark, sf_dir)
    return search.neighbours(rows, rows).select("id", "document_id", "chunk_index", "context_before", "context_after")


@query(f"""
WITH RECURSIVE {_SNIPPETS}, {_bm25_sql(_TERMS, 'relaxed', 'snippets', 'id', 'content')},
best AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10)
SELECT s.id AS snippet_id, s.document_id, s.kind, s.content, s.chunk_index, d.source AS document_title, b.content AS context_before, a.content AS context_after, round(best.score, 6) AS score
FROM best JOIN snippets s USING (id) JOIN documents d ON d.doc_id = s.document_id
LEFT JOIN snippets b ON b.document_id = s.document_id AND b.kind = 'excerpt' AND b.chunk_index = s.chunk_index - 1
LEFT JOIN snippets a ON a.document_id = s.document_id AND a.kind = 'excerpt' AND a.chunk_index = s.chunk_index + 1
""")
def search_result(spark, sf_dir):
    rows = _snippets(spark, sf_dir)
    best = search.top(search.bm25(index.tokenized(rows), search.query_terms("", _TERMS)), 10)
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("ingested_at"))
    return search.results(best, rows, documents).drop("document_url", "ingested_at").withColumn("score", F.round("score", 6))


_MODELS = "SELECT vec_id AS id, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding, CASE WHEN vec_id % 7 <> 0 THEN 'model-' || (label % 3) END AS embedding_model FROM embeddings"


def _models(spark, sf_dir) -> DataFrame:
    here = F.col("vec_id") % 7 != 0
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(here, F.col("embedding")).alias("embedding"), F.when(here, F.concat(F.lit("model-"), (F.col("label") % 3).cast("string"))).alias("embedding_model"))


@query(f"SELECT id, embedding_model FROM ({_MODELS}) WHERE embedding IS NULL OR embedding_model IS DISTINCT FROM 'model-1'")
def reembed_candidates(spark, sf_dir):
    return store.stale(_models(spark, sf_dir), "model-1").select("id", "embedding_model")


@query(f"SELECT count(*) AS total, count(embedding) AS embedded, count(*) FILTER (embedding IS NOT NULL AND embedding_model = 'model-1') AS skipped FROM ({_MODELS})")
def embedding_counts(spark, sf_dir):
    rows = _models(spark, sf_dir)
    fresh = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit("model-1"))
    return rows.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), F.count(F.when(fresh, 1)).alias("skipped"))


@query("SELECT vec_id, (len(embedding) * 4)::INT AS n_bytes, embedding FROM embeddings")
def vector_codec(spark, sf_dir):
    packed = _table(spark, sf_dir, "embeddings").select("vec_id", files.pack_vectors("embedding").alias("blob"))
    return packed.select("vec_id", F.length("blob").alias("n_bytes"), files.unpack_vectors("blob").alias("embedding"))


# --- store and memory -------------------------------------------------------

_PAGES = """
pg AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]', '', 'g') END AS url FROM pages),
kn AS (SELECT url, min(page_id) AS id FROM pg WHERE page_id < 20 AND url <> '' GROUP BY url),
nw AS (SELECT page_id, pg.url, kn.id AS known, row_number() OVER (PARTITION BY pg.url ORDER BY page_id) AS r FROM pg LEFT JOIN kn ON kn.url = pg.url WHERE page_id >= 20),
fresh AS (SELECT (SELECT coalesce(max(page_id), 0) FROM pg WHERE page_id < 20) + row_number() OVER (ORDER BY page_id) AS id, url FROM nw WHERE url IS NULL OR (known IS NULL AND r = 1))
"""


def _captured(spark, sf_dir):
    url = F.when(F.col("page_id") % 11 != 0, F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[0-9]", ""))
    rows = _table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.lit("url").alias("source_type"), F.col("html").alias("raw_text"))
    return store.capture(rows.filter("page_id >= 20").withColumnRenamed("page_id", "arrival"), rows.filter("page_id < 20").select(F.col("page_id").alias("id"), "url"))


@query(f"WITH {_PAGES} SELECT id, url, 'pending' AS status FROM fresh")
def captured_documents(spark, sf_dir):
    return _captured(spark, sf_dir)[0].select("id", "url", "status")


@query(f"WITH {_PAGES} SELECT page_id AS arrival, nw.url, coalesce(known, fresh.id) AS document_id FROM nw LEFT JOIN fresh ON fresh.url = nw.url WHERE nw.url IS NOT NULL AND (known IS NOT NULL OR r > 1)")
def captured_duplicates(spark, sf_dir):
    return _captured(spark, sf_dir)[1].select("arrival", "url", "document_id")


@query(r"""
WITH u AS (SELECT page_id, lpad(to_hex(page_id * 7919 + 17), 11, '_') AS id, page_id % 6 AS k FROM pages),
w AS (SELECT page_id, CASE k WHEN 0 THEN id WHEN 1 THEN id WHEN 2 THEN id WHEN 3 THEN id WHEN 4 THEN NULL ELSE id END AS video_id FROM u)
SELECT page_id, video_id FROM w
""")
def video_ids(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.lpad(F.hex(F.col("page_id") * 7919 + 17), 11, "_").alias("id"))
    k = F.col("page_id") % 6
    url = (
        F.when(k == 0, F.col("id")).when(k == 1, F.concat(F.lit("https://youtu.be/"), "id", F.lit("?t=3"))).when(k == 2, F.concat(F.lit("https://www.youtube.com/watch?x=1&v="), "id"))
        .when(k == 3, F.concat(F.lit("http://m.youtube.com/shorts/"), "id", F.lit("/"))).when(k == 4, F.concat(F.lit("https://example.com/watch?v="), "id")).otherwise(F.concat(F.lit(" https://music.youtube.com/watch?v="), "id", F.lit("&list=z ")))
    )
    return rows.select("page_id", X.video_id(url).alias("video_id"))


_LOG = "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'replace' ELSE 'write' END AS op, user_id AS entity_id, event_type AS attribute, value::VARCHAR AS v, ts, max(CASE WHEN event_id % 5 = 0 THEN event_id END) OVER (PARTITION BY user_id, event_type) AS last FROM events"
_STATE = f"SELECT id, entity_id, attribute, round(v::DOUBLE, 2) AS value, ts AS observed_at, coalesce(last > id, FALSE) OR id % 97 = 0 AS superseded FROM ({_LOG})"


def _log(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    facts = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "replace").otherwise("write").alias("op"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("attribute"), F.col("value").cast("string").alias("value"), none.alias("body"), none.alias("source"), F.col("ts").alias("observed_at"), F.lit(None).cast("bigint").alias("target"))
    gone = facts.filter("id % 97 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("supersede").alias("op"), "entity_id", "attribute", none.alias("value"), none.alias("body"), none.alias("source"), "observed_at", F.col("id").alias("target"))
    return facts.unionByName(gone)


def _state(spark, sf_dir) -> DataFrame:
    return memory.fold_log(_log(spark, sf_dir))[0].withColumn("value", F.round(F.col("value").cast("double"), 2))


@query(f"SELECT id, entity_id, attribute, value, observed_at FROM ({_STATE}) WHERE NOT superseded")
def current_observations(spark, sf_dir):
    return _state(spark, sf_dir).filter(~F.col("superseded")).select("id", "entity_id", "attribute", "value", "observed_at")


@query(f"SELECT id, attribute, value, superseded FROM ({_STATE}) WHERE entity_id = 5")
def observation_history(spark, sf_dir):
    return memory.get_observations(_state(spark, sf_dir), 5, include_superseded=True).select("id", "attribute", "value", "superseded")


@query("""
WITH e AS (SELECT event_id AS id, user_id AS entity_id, event_type AS attribute, event_id % 5 = 0 AS rep FROM events),
g AS (SELECT *, count(*) FILTER (rep) OVER (PARTITION BY entity_id, attribute ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS era FROM e),
c AS (SELECT *, count(*) OVER (PARTITION BY entity_id, attribute, era ORDER BY id) - 1 AS ahead FROM g)
SELECT id, entity_id, attribute, (ahead + (era > 0)::INT)::BIGINT AS retired FROM c WHERE rep
""")
def retired_counts(spark, sf_dir):
    return memory.retired(_log(spark, sf_dir))


def _resolved(spark, sf_dir) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    n = _table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    entities = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("The Land "), key).alias("full_name"), F.lit(None).cast("string").alias("relation"), F.concat(F.lit("AL"), (F.col("n_nationkey") * 3).cast("string"), F.lit(", ")).alias("aliases"))
    r = _table(spark, sf_dir, "region")
    needles = customers.select(F.concat("c_name", F.lit(" of NATION_"), (F.col("c_nationkey") % 30).cast("string")).alias("needle"))
    needles = needles.union(r.select(F.concat(F.lit("Land "), (F.col("r_regionkey") + 1).cast("string")))).union(r.select(F.concat(F.lit("aL"), (F.col("r_regionkey") * 3).cast("string")))).union(spark.createDataFrame([(" ",)], "needle string"))
    return memory.resolve(entities, needles)


@query("""
WITH ent AS (SELECT n_nationkey::BIGINT AS id, lower(n_name) AS name FROM nation UNION ALL SELECT n_nationkey::BIGINT, 'the land ' || n_nationkey FROM nation UNION ALL SELECT n_nationkey::BIGINT, 'al' || (n_nationkey * 3) FROM nation),
need AS (SELECT c_name || ' of NATION_' || (c_nationkey % 30) AS needle FROM customer UNION SELECT 'Land ' || (r_regionkey + 1) FROM region UNION SELECT 'aL' || (r_regionkey * 3) FROM region UNION SELECT ' ')
SELECT DISTINCT needle, id AS entity_id FROM need JOIN ent ON trim(needle) <> '' AND (contains(lower(trim(needle)), name) OR contains(name, lower(trim(needle))))
""")
def entity_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("""
SELECT s_suppkey, nullif(array_to_string(list_filter(list_transform([s_name, ' ', ' b ', ''], lambda x: trim(x)), lambda x: x <> ''), ','), '') AS tags,
  lower(s_name) || ',x' || (s_suppkey % 3) AS aliases, lower(replace(s_name, '#', '-')) AS slug FROM supplier
""")
def normalized_names(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    alias = F.concat(F.lit("X"), (F.col("s_suppkey") % 3).cast("string"))
    listed = F.concat(F.lit(" "), "s_name", F.lit(",, "), alias, F.lit(","), F.lower("s_name"))
    return s.select("s_suppkey", X.join_tags(F.array("s_name", F.lit(" "), F.lit(" b "), F.lit(""))).alias("tags"), X.add_alias(listed, F.concat(alias, F.lit(" "))).alias("aliases"), X.slug(F.concat(F.lit("/some/where/"), "s_name", F.lit(".md"))).alias("slug"))


@query("""
WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN '[1]' WHEN 3 THEN '{"author":"A' || user_id || '","video":{}}'
  WHEN 4 THEN '{"video":{"chapters":[]}}' ELSE '{"author":"B","video":{"chapters":[{"title":"t","start":1.5,"end":2.0}]}}' END AS j, CASE WHEN event_id % 4 = 0 THEN 'url' ELSE 'transcript' END AS kind, event_id % 3 = 0 AS used FROM events),
o AS (SELECT *, CASE WHEN j IS NOT NULL AND json_valid(j) THEN CASE WHEN json_type(j) = 'OBJECT' THEN j::JSON END END AS v FROM m),
c AS (SELECT *, CASE WHEN kind = 'transcript' THEN json_array_length(v, '$.video.chapters') END AS n FROM o)
SELECT event_id, coalesce(json_extract_string(v, '$.author'), '') AS author, n::INT AS n_chapters,
  CASE WHEN kind = 'transcript' AND json_extract(v, '$.video.chapters') IS NULL THEN 'chapters were never recorded for this transcript'
    WHEN n > 0 AND NOT used THEN 'this transcript has chapters and the chunks do not use them' END AS refused
FROM c
""")
def metadata_gate(spark, sf_dir):
    e, k = _table(spark, sf_dir, "events"), F.col("event_id") % 6
    j = (
        F.when(k == 1, "not json").when(k == 2, "[1]").when(k == 3, F.concat(F.lit('{"author":"A'), F.col("user_id").cast("string"), F.lit('","video":{}}')))
        .when(k == 4, '{"video":{"chapters":[]}}').when(k == 5, '{"author":"B","video":{"chapters":[{"title":"t","start":1.5,"end":2.0}]}}')
    )
    rows = e.select("event_id", j.alias("j"), F.when(F.col("event_id") % 4 == 0, "url").otherwise("transcript").alias("kind"), (F.col("event_id") % 3 == 0).alias("used"))
    found = metadata.chapters("j", "kind")
    return rows.select("event_id", metadata.author("j").alias("author"), F.when(found.isNotNull(), F.size(found)).alias("n_chapters"), metadata.gate("j", "kind", "used").alias("refused"))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'discarded' WHEN l.quality = 1 THEN 'kept' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_updates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("pending").alias("status"))
    labels = _table(spark, sf_dir, "labels")
    first = labels.filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit("kept").alias("value"), F.lit(0).alias("position"))
    last = labels.filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("discarded").alias("value"), F.lit(1).alias("position"))
    wrong = labels.select(F.col("doc_id").alias("id"), F.lit("burnt").alias("value"), F.lit(2).alias("position"))
    changed, _ = store.set_status(docs, first.union(last).union(wrong))
    return changed.withColumnRenamed("id", "doc_id")


# --- captions ---------------------------------------------------------------


def _cues(spark, sf_dir) -> DataFrame:
    """Rolling cues over all words of each turn: of every three words two, all, the last two, and an empty cue."""
    t = _table(spark, sf_dir, "conversations").withColumn("w", F.split("text", r"[ \n]+"))
    t = t.select("conv_id", "turn", "w", F.explode(F.expr("sequence(0, (size(w) - 1) DIV 3)")).alias("s"))
    at = lambda k: F.col("s") * 4 + k
    part = lambda k, a, n: F.struct((F.col("turn").cast("bigint") * (1 << 32) + at(k)).alias("position"), (F.col("turn") * 100000.0 + at(k) * 2).alias("start"), F.array_join(F.slice("w", (F.col("s") * 3 + a).cast("int"), n), " ").alias("text"))
    cues = t.select("conv_id", F.explode(F.array(part(0, 1, 2), part(1, 1, 3), part(2, 2, 2), part(3, 1, 0))).alias("c")).select("conv_id", "c.*")
    return cues.withColumn("duration", F.lit(2.0)).withColumn("timestamp", X.format_stamp("start"))


@query(r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_split_to_array(text, '[ \n]+') AS w FROM conversations),
s AS (SELECT *, unnest(range(0, (len(w) + 2) // 3)) AS s FROM t),
k AS (SELECT unnest([0, 1, 2, 3]) AS k),
c AS (SELECT conv_id, turn::BIGINT * 4294967296 + s * 4 + k AS position, turn * 100000::DOUBLE + 2 * (s * 4 + k) AS start,
  array_to_string(CASE k WHEN 0 THEN w[s * 3 + 1 : s * 3 + 2] WHEN 1 THEN w[s * 3 + 1 : s * 3 + 3] WHEN 2 THEN w[s * 3 + 2 : s * 3 + 3] ELSE [] END, ' ') AS text FROM s, k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY position) AS p FROM c WHERE text <> ''),
f AS (
  SELECT conv_id, p, 0 AS segment, start, 2.0::DOUBLE AS duration, text FROM o WHERE p = 1
  UNION ALL
  SELECT o.conv_id, o.p, CASE WHEN contains(f.text, o.text) OR starts_with(o.text, f.text) THEN f.segment ELSE f.segment + 1 END,
    CASE WHEN contains(f.text, o.text) OR starts_with(o.text, f.text) THEN f.start ELSE o.start END,
    CASE WHEN contains(f.text, o.text) THEN greatest(o.start + 2 - f.start, f.duration) WHEN starts_with(o.text, f.text) THEN o.start + 2 - f.start ELSE 2 END,
    CASE WHEN contains(f.text, o.text) THEN f.text ELSE o.text END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.p = f.p + 1)
SELECT conv_id, segment, start, arg_max(duration, p) AS duration, arg_max(text, p) AS text FROM f GROUP BY conv_id, segment, start
""")
def caption_dedupe(spark, sf_dir):
    return captions.dedupe(_cues(spark, sf_dir), "conv_id").select("conv_id", "segment", "start", "duration", "text")


@query(r"""
SELECT conv_id, turn AS position, (turn * 70)::DOUBLE AS start, 2.5::DOUBLE AS duration,
  CASE WHEN turn * 70 >= 3600 THEN lpad((turn * 70 // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((turn * 70 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 70 % 60)::VARCHAR, 2, '0') AS timestamp,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS text
FROM conversations WHERE turn % 5 <> 3
""")
def vtt_cues(spark, sf_dir):
    t, s = _table(spark, sf_dir, "conversations"), F.col("turn") * 70
    stamp = lambda extra: F.concat(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60), F.lit(extra))
    stop = F.concat(F.format_string("%02d:%02d:%02d", F.floor((s + 2) / 3600), F.floor((s + 2) % 3600 / 60), (s + 2) % 60), F.lit(",500"))
    cue = F.concat(F.when(F.col("turn") % 5 == 3, "xx:yy").otherwise(stamp(".000")), F.lit(" --> "), stop, F.lit(" align:start\n<c.a>"), F.replace("text", F.lit(" "), F.lit(" <b> ")), F.lit("</c>"))
    cues = F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"])
    made = t.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n\n")).alias("vtt"), F.sort_array(F.collect_list("turn")).alias("turns"))
    found = captions.parse_vtt(made, "conv_id")
    # the first block is the file's head
    return found.join(made.select("conv_id", "turns"), "conv_id").select("conv_id", F.get("turns", F.col("position") - 1).alias("position"), "start", "duration", "timestamp", "text")


@query("""
WITH s AS (SELECT event_id, (event_id * 13 % 9000)::INT AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS stamp,
  CASE WHEN s = 0 THEN '' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS duration,
  s AS seconds
FROM s
""")
def stamps(spark, sf_dir):
    s = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 13 % 9000).cast("int").alias("s"))
    return s.select("event_id", X.format_stamp("s").alias("stamp"), X.format_duration("s").alias("duration"), X.stamp_seconds(X.format_stamp("s")).alias("seconds"))


# --- evaluation -------------------------------------------------------------


@query("SELECT (doc_id % 10)::BIGINT AS doc_group, round(avg(quality * 5.0 + toxic), 6) AS mean_score, count(*) AS n_scored FROM labels GROUP BY ROLLUP (doc_id % 10)")
def mean_scores(spark, sf_dir):
    verdicts = _table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("doc_group"), (F.col("quality") * 5.0 + F.col("toxic")).alias("score"))
    return evaluation.mean_scores(verdicts, "doc_group").withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT doc_id, '| ' || doc_id || ' | ' || printf('%.1f', quality * 2.5) || ' | a b |' AS line FROM labels")
def score_lines(spark, sf_dir):
    verdicts = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2.5).cast("double").alias("score"), F.lit("a\n b").alias("reasoning"))
    return evaluation.score_table(verdicts, ["doc_id", "score", "reasoning"]).select("doc_id", "line")

