"""Queries over the writes of the store and the memory, capture and whole searches, with their SQL twins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainery import schemas
from grainery.functions import text as X
from grainery.operators import captions, chunking, index, memory, search, store
from grainery.plans.catalogue import _CHUNKS, _COSINE, _TERMS, _bm25_sql, _chunks, _models, _snippets, _table, _vector, query
from grainery.sources import files, providers


@dataclass(frozen=True)
class Lengths:
    """Vectors that SQL can make as well: a text's length and its number of the letter e."""

    model: str = "model-1"
    width: int = 2

    def vectors(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in texts]


#: The same in SQL, with the instruction before a document.
_LENGTHS = "[length('title: none | text: ' || {0})::FLOAT, (3 + length({0}) - length(replace({0}, 'e', '')))::FLOAT]"


# --- snippets ---------------------------------------------------------------

_BATCH = """
batch AS (
  SELECT event_id, event_id % 1200 AS document_id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_type END AS content,
    CASE event_id % 5 WHEN 1 THEN 'synthesis' WHEN 2 THEN 'rejection' WHEN 3 THEN 'odd' ELSE 'excerpt' END AS kind, (event_id % 9)::INT AS chunk_index, ts FROM events),
judged AS (
  SELECT *, CASE WHEN content = ' ' THEN 'empty content' WHEN kind = 'odd' THEN 'unknown kind' WHEN document_id NOT IN (SELECT doc_id FROM documents) THEN 'no such document' END AS error FROM batch)
"""


def _written(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = F.col("event_id")
    kind = F.when(n % 5 == 1, "synthesis").when(n % 5 == 2, "rejection").when(n % 5 == 3, "odd").otherwise("excerpt")
    batch = _table(spark, sf_dir, "events").select(
        (n % 1200).alias("document_id"), F.when(n % 13 == 0, " ").otherwise(F.col("event_type")).alias("content"), kind.alias("kind"), (n % 9).cast("int").alias("chunk_index"),
        F.lit(None).cast("string").alias("tags"), F.col("ts").alias("created_at"), n.alias("position"),
    )
    known = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    return store.write_snippets(batch.repartition(16, "content"), _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), known)


@query(f"""
WITH {_BATCH}
SELECT (SELECT max(r_regionkey) FROM region)::BIGINT + row_number() OVER (ORDER BY event_id) AS id, document_id, content, kind, CASE WHEN kind = 'excerpt' THEN chunk_index END AS chunk_index, ts AS created_at
FROM judged WHERE error IS NULL
""")
def written_snippets(spark, sf_dir):
    return _written(spark, sf_dir)[0].select("id", "document_id", "content", "kind", "chunk_index", "created_at")


@query(f"WITH {_BATCH} SELECT event_id AS position, FALSE AS ok, error FROM judged WHERE error IS NOT NULL")
def rejected_snippets(spark, sf_dir):
    return _written(spark, sf_dir)[1].select("position", "ok", "error")


_ALLOWED = f"""
{_CHUNKS},
stored AS (
  SELECT row_number() OVER (ORDER BY doc_id, chunk_index) AS id, doc_id AS document_id, chunk_index, content, {_LENGTHS.format("content")} AS embedding
  FROM chunks WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0))
"""


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, n = _table(spark, sf_dir, "documents"), F.col("doc_id")
    meta = F.when(n % 2 == 1, '{"video":{"chapters":[]}}')
    documents = docs.select(n.alias("id"), F.when(n % 3 == 0, "transcript").otherwise("url").alias("source_type"), meta.alias("source_metadata"))
    found = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    sums = chunking.summaries(docs).withColumnRenamed("doc_id", "document_id")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return store.write_chunks(found, sums, documents, schemas.empty(spark, "snippets"), now, embed=lambda rows: files.embed_rows(rows, Lengths()))


@query(f"WITH RECURSIVE {_ALLOWED} SELECT id, document_id, chunk_index, content, embedding, 'model-1' AS embedding_model, 'excerpt' AS kind FROM stored")
def written_chunks(spark, sf_dir):
    return _stored(spark, sf_dir)[0].select("id", "document_id", "chunk_index", "content", "embedding", "embedding_model", "kind")


@query(f"WITH RECURSIVE {_ALLOWED} SELECT document_id, count(*) AS written, count(*) AS embedded FROM stored GROUP BY document_id")
def written_counts(spark, sf_dir):
    return _stored(spark, sf_dir)[1]


@query("SELECT doc_id AS document_id, 'chapters were never recorded for this transcript' AS error FROM documents WHERE doc_id % 6 = 0")
def refused_documents(spark, sf_dir):
    return _stored(spark, sf_dir)[2]


@query(f"""
WITH RECURSIVE {_CHUNKS}
SELECT doc_id AS document_id, chunk_index, CASE WHEN doc_id % 2 = 0 THEN prefix || ' — A' ELSE prefix END AS prefix, CASE WHEN doc_id % 2 = 0 THEN prefix || ' — A' ELSE prefix END || content[length(prefix) + 1:] AS content
FROM chunks WHERE doc_id % 4 <> 2
""")
def stored_chunks(spark, sf_dir):
    return chunking.stored(*_archive(spark, sf_dir))[0].select("document_id", "chunk_index", "prefix", "content")


@query("""
SELECT doc_id AS document_id, doc_id % 4 <> 2 AS ok, CASE WHEN doc_id % 4 = 2 THEN 'chapters were never recorded for this transcript' END AS error FROM documents
UNION ALL SELECT doc_id + 1000000000, FALSE, 'no such document' FROM documents WHERE doc_id % 10 = 0
""")
def stored_summaries(spark, sf_dir):
    return chunking.stored(*_archive(spark, sf_dir))[1].select("document_id", "ok", "error")


def _archive(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored documents, half of them transcripts, and the ids asked for: all, and some that there are not."""
    docs, n = _table(spark, sf_dir, "documents"), F.col("doc_id")
    meta = F.when(n % 4 == 0, '{"author":"A","video":{"chapters":[]}}').when(n % 4 == 2, '{"author":"A"}')
    kind = F.when(n % 2 == 0, "transcript").otherwise("file")
    documents = docs.select(n.alias("id"), F.col("source").alias("title"), kind.alias("source_type"), F.col("text").alias("raw_text"), meta.alias("source_metadata"))
    return documents, docs.select(n.alias("id")).union(docs.filter(n % 10 == 0).select(n + 1_000_000_000))


@query(f"""
SELECT id, CASE WHEN stale THEN 'model-1' ELSE embedding_model END AS embedding_model, CASE WHEN stale THEN {_LENGTHS.format("'e' || id")} ELSE embedding END AS embedding
FROM (SELECT vec_id AS id, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding, CASE WHEN vec_id % 7 <> 0 THEN 'model-' || (label % 3) END AS embedding_model, vec_id % 7 = 0 OR label % 3 <> 1 AS stale FROM embeddings)
""")
def reembedded(spark, sf_dir):
    return _reembedded(spark, sf_dir)[0].select("id", "embedding_model", "embedding")


@query("SELECT count(*) FILTER (stale) AS selected, count(*) FILTER (stale) AS embedded, count(*) FILTER (NOT stale) AS skipped FROM (SELECT vec_id % 7 = 0 OR label % 3 <> 1 AS stale FROM embeddings)")
def reembed_counts(spark, sf_dir):
    return _reembedded(spark, sf_dir)[1]


def _reembedded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _models(spark, sf_dir).withColumn("content", F.concat(F.lit("e"), F.col("id").cast("string")))
    return store.reembed(rows, "model-1", lambda chosen: files.embed_rows(chosen, Lengths()))


# --- documents --------------------------------------------------------------


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good ' || l.doc_id END AS agent_summary FROM documents d LEFT JOIN labels l USING (doc_id)")
def summary_updates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("agent_summary"))
    value = F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("doc_id").cast("string"))).otherwise(" \n")
    changes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), value.alias("value"), F.lit(0).alias("position"))
    return store.set_summary(docs, changes)[0].withColumnRenamed("id", "doc_id")


@query("SELECT count(*) FILTER (l.toxic = 1) AS affected FROM documents d JOIN labels l USING (doc_id)")
def affected_rows(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("kept").alias("status"))
    value = F.when(F.col("toxic") == 1, "discarded").otherwise("kept")
    changes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), value.alias("value"), F.lit(0).alias("position"))
    return store.affected(docs, store.set_status(docs, changes)[0], "status")


@query("SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'discarded' ELSE 'kept' END AS status FROM documents")
def discarded_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("kept").alias("status"))
    return store.discard(docs, docs.filter("id % 3 = 0").select("id"))[0].withColumnRenamed("id", "doc_id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'pending' END AS status, text AS raw_text, NULL::VARCHAR AS agent_summary, NULL::VARCHAR AS source_metadata FROM documents")
def migrated_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))
    old = schemas.migrate(docs.filter("id % 2 = 1"), "documents").unionByName(schemas.migrate(docs.filter("id % 2 = 0").withColumn("status", F.lit("kept")), "documents"))
    return old.select("id", "status", "raw_text", "agent_summary", "source_metadata")


# --- memory -----------------------------------------------------------------

_PEOPLE = """
people AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 89 = 0 THEN ' ' WHEN c_custkey % 50 = 0 THEN 'x' || 'NATION_' || (c_custkey % 25) || '!' WHEN c_custkey % 50 = 3 THEN lag(c_name) OVER (ORDER BY c_custkey) || ' jr' ELSE c_name END AS name,
    CASE WHEN c_custkey % 97 = 0 THEN 'ghost' ELSE 'person' END AS kind FROM customer),
good AS (SELECT *, lower(trim(name)) AS low FROM people WHERE trim(name) <> '' AND kind <> 'ghost'),
seen AS (SELECT k, name, low, kind, (SELECT min(n_nationkey) FROM nation WHERE contains(low, lower(n_name)) OR contains(lower(n_name), low))::BIGINT AS known FROM good),
again AS (SELECT *, known IS NULL AND EXISTS (SELECT 1 FROM seen e WHERE e.k < s.k AND e.known IS NULL AND (contains(s.low, e.low) OR contains(e.low, s.low))) AS repeats FROM seen s)
"""


def _people(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k, none = _table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit(None).cast("string")
    before = c.select((k + 1).alias("c_custkey"), F.concat("c_name", F.lit(" jr")).alias("junior"))
    name = F.when(k % 89 == 0, " ").when(k % 50 == 0, F.concat(F.lit("xNATION_"), (k % 25).cast("string"), F.lit("!"))).when(k % 50 == 3, F.col("junior")).otherwise(F.col("c_name"))
    batch = c.join(before, "c_custkey", "left").select(
        k.alias("position"), name.alias("name"), F.when(k % 97 == 0, "ghost").otherwise("person").alias("kind"), none.alias("aliases"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at")
    )
    table = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), none.alias("full_name"), none.alias("relation"), none.alias("aliases"))
    return memory.create_entities(batch, table)


@query(f"WITH {_PEOPLE} SELECT (SELECT max(n_nationkey) FROM nation)::BIGINT + row_number() OVER (ORDER BY k) AS id, name, kind FROM again WHERE known IS NULL AND NOT repeats")
def created_entities(spark, sf_dir):
    return _people(spark, sf_dir)[0].select("id", "name", "kind")


@query(f"WITH {_PEOPLE} SELECT k AS position, name, known AS entity_id, TRUE AS duplicate FROM again WHERE known IS NOT NULL OR repeats")
def repeated_entities(spark, sf_dir):
    return _people(spark, sf_dir)[1]


@query("SELECT n_nationkey::BIGINT AS entity_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'place' ELSE 'org' END AS kind FROM nation WHERE n_nationkey % 2 = 0")
def listed_entities(spark, sf_dir):
    return memory.list_entities(_places(spark, sf_dir), "place")


@query("SELECT n_nationkey::BIGINT AS entity_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'place' ELSE 'org' END AS kind FROM nation WHERE n_nationkey = 7")
def one_entity(spark, sf_dir):
    return memory.get_entity(_places(spark, sf_dir), 7)


def _places(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(n.cast("bigint").alias("id"), F.col("n_name").alias("name"), F.when(n % 2 == 0, "place").otherwise("org").alias("kind"))


@query("SELECT event_id AS id, 'no active observation' AS error FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id + 1000000000, 'no active observation' FROM events WHERE event_id % 5 = 0")
def supersede_errors(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    state = e.withColumn("superseded", F.col("id") % 2 == 0)
    return memory.supersede_errors(state, e.filter("id % 3 = 0").union(e.filter("id % 5 = 0").select(F.col("id") + 1_000_000_000)))


# --- index and search -------------------------------------------------------


@query(r"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 10 = 0 THEN lang || ' anew ' || source ELSE text END)), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id % 20 <> 10)
SELECT term, id, count(*) AS tf FROM t GROUP BY ALL
""")
def refreshed_postings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    old = index.postings(index.tokenized(docs, "doc_id", "text", None))
    changed = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("id"))
    anew = index.tokenized(docs.filter("doc_id % 20 = 0").withColumn("text", F.concat_ws(" anew ", "lang", "source")), "doc_id", "text", None)
    return index.refresh(old, changed, anew)


@query(f"""
WITH RECURSIVE {_CHUNKS},
snippets AS (
  SELECT c.doc_id * 1000 + chunk_index AS id, c.doc_id AS document_id, content, CASE WHEN chunk_index % 4 = 2 THEN 'synthesis' ELSE 'excerpt' END AS kind, CASE WHEN chunk_index % 4 <> 2 THEN chunk_index END AS chunk_index,
    CASE WHEN chunk_index = 0 THEN embedding END AS embedding, 'model-' || (label % 2) AS model
  FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id),
{_bm25_sql(_TERMS, 'relaxed', 'snippets', 'id', 'content')},
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
cs AS (SELECT id, list_cosine_similarity(embedding::DOUBLE[], q.e) AS score FROM snippets, q WHERE embedding IS NOT NULL AND model = 'model-1'),
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY score DESC, id LIMIT 50),
ve AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM cs ORDER BY score DESC, id LIMIT 50),
best AS (
  SELECT id, coalesce(1.0::DOUBLE / (60 + kw.r), 0) + coalesce(1.0::DOUBLE / (60 + ve.r), 0) AS score FROM kw FULL JOIN ve USING (id)
  ORDER BY score DESC, kw.r NULLS LAST, ve.r NULLS LAST LIMIT 10)
SELECT s.id AS snippet_id, s.document_id, s.kind, s.content, s.chunk_index, d.source AS document_title, b.content AS context_before, a.content AS context_after, round(best.score, 9) AS score
FROM best JOIN snippets s USING (id) JOIN documents d ON d.doc_id = s.document_id
LEFT JOIN snippets b ON b.document_id = s.document_id AND b.kind = 'excerpt' AND b.chunk_index = s.chunk_index - 1
LEFT JOIN snippets a ON a.document_id = s.document_id AND a.kind = 'excerpt' AND a.chunk_index = s.chunk_index + 1
""")
def hybrid_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding", F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")).alias("embedding_model"))
    rows = _snippets(spark, sf_dir).join(vectors, "document_id", "left").withColumn("embedding", F.when(F.col("chunk_index") == 0, F.col("embedding")))
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("ingested_at"))
    found = search.hybrid(rows, documents, " ".join(_TERMS), _vector(spark, sf_dir), terms=_TERMS, model="model-1")
    return found.drop("document_url", "ingested_at").withColumn("score", F.round("score", 9))


@query(f"WITH {_COSINE} SELECT CASE WHEN count(*) > 0 THEN 'vector_only' ELSE 'none' END AS backend FROM cs")
def search_without_terms(spark, sf_dir):
    rows = index.tokenized(_table(spark, sf_dir, "documents"), "doc_id", "text", None)
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    none = search.top(search.bm25(rows, search.query_terms("-- ?!") or []), 50)
    return search.backend(none, search.top(search.cosine_scores(vectors, _vector(spark, sf_dir)), 50))


@query("SELECT 'fts_only' AS backend")
def search_without_vectors(spark, sf_dir):
    rows = index.tokenized(_table(spark, sf_dir, "documents"), "doc_id", "text", None)
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = search.query_vector(providers.Off(), "anything")
    return search.backend(search.top(search.bm25(rows, search.query_terms("", _TERMS)), 50), search.top(search.cosine_scores(vectors, asked or []), 50))


# --- captions ---------------------------------------------------------------


@query("SELECT page_id AS video_id, '/subs/' || page_id || '/v.en.vtt' AS path, 'en' AS language, FALSE AS is_generated FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '/subs/' || page_id || '/v.fr-orig.vtt', 'fr-orig', TRUE FROM pages WHERE page_id % 2 = 1")
def chosen_subtitles(spark, sf_dir):
    n, base = F.col("page_id"), F.concat(F.lit("/subs/"), F.col("page_id").cast("string"))
    names = F.array(F.when(n % 2 == 0, F.concat(base, F.lit("/v.en.vtt"))), F.concat(base, F.lit("/v.fr-orig.vtt")), F.concat(base, F.lit("/v.pt-BR-orig.vtt")))
    rows = _table(spark, sf_dir, "pages").select(n.alias("video_id"), F.explode(F.filter(names, lambda p: p.isNotNull())).alias("path"))
    return captions.choose_subtitles(rows)


def _output(spark, sf_dir) -> DataFrame:
    """A tool's output for each page: a warning, its JSON, and more lines."""
    n = F.col("page_id")
    chapters = '"chapters":[{"title":" c ","start_time":1,"end_time":2.5},{"title":"","start_time":3},{"title":"n"}]'
    body = F.concat(F.lit('{"title":"T'), n.cast("string"), F.lit('","channel":" ","uploader":'), F.when(n % 3 == 0, '" U "').otherwise("null"), F.lit(',"creator":"C","duration":'), (n * 7 % 5000).cast("string"), F.when(n % 2 == 0, "," + chapters).otherwise(""), F.lit("}"))
    text = F.when(n % 5 == 0, "nothing\n[1]").otherwise(F.concat(F.lit("warning {\n"), body, F.lit('\n{"title":"no"}')))
    return _table(spark, sf_dir, "pages").select(n.alias("video_id"), text.alias("output"))


@query("""
SELECT page_id AS video_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'T' || page_id END AS title, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 3 = 0 THEN 'U' ELSE 'C' END AS channel,
  CASE WHEN page_id % 5 <> 0 THEN (page_id * 7 % 5000)::DOUBLE END AS duration, CASE WHEN page_id % 5 <> 0 AND page_id % 2 = 0 THEN 1 ELSE 0 END::INT AS n_chapters, CASE WHEN page_id % 5 <> 0 AND page_id % 2 = 0 THEN 'c 1.0 2.5' END AS chapter
FROM pages
""")
def video_records(spark, sf_dir):
    output = _output(spark, sf_dir)
    first = F.get("chapters", F.lit(0))
    found = captions.video_metadata(output).join(captions.video_chapters(output), "video_id")
    return found.select("video_id", "title", "channel", "duration", F.size("chapters").alias("n_chapters"), F.when(first.isNotNull(), F.concat_ws(" ", first["title"], first["start"].cast("string"), first["end"].cast("string"))).alias("chapter"))


@query(r"""
WITH RECURSIVE o AS (
  SELECT conv_id, (turn * 8)::DOUBLE AS start, lpad((turn * 8 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 8 % 60)::VARCHAR, 2, '0') AS stamp, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
f AS (
  SELECT conv_id, p, 0 AS segment, stamp, text FROM o WHERE p = 1
  UNION ALL
  SELECT o.conv_id, o.p, CASE WHEN contains(f.text, o.text) OR starts_with(o.text, f.text) THEN f.segment ELSE f.segment + 1 END,
    CASE WHEN contains(f.text, o.text) OR starts_with(o.text, f.text) THEN f.stamp ELSE o.stamp END, CASE WHEN contains(f.text, o.text) THEN f.text ELSE o.text END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.p = f.p + 1),
s AS (SELECT conv_id, segment, stamp, arg_max(text, p) AS text FROM f GROUP BY conv_id, segment, stamp)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'api' ELSE 'files' END AS origin, string_agg('[' || stamp || '] ' || text, chr(10) ORDER BY segment) AS text, count(*) AS n_segments,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'T' END AS title, CASE WHEN conv_id % 3 = 0 THEN '{"video":{"video_id":"' || conv_id || '","duration":""}}' ELSE '{"author":"C","video":{"video_id":"' || conv_id || '","duration":"1:05","chapters":[]}}' END AS source_metadata
FROM s GROUP BY conv_id
""")
def captured_videos(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    rows = t.select("conv_id", F.col("turn").alias("position"), (F.col("turn") * 8.0).alias("start"), F.lit(2.0).alias("duration"), X.format_stamp(F.col("turn") * 8).alias("timestamp"), "text")
    output = t.select("conv_id").distinct().filter("conv_id % 3 <> 0").withColumn("output", F.lit('{"title":"T","channel":"C","duration":65}'))
    found = captions.captured(rows.filter("conv_id % 2 = 0"), rows, output, "conv_id")
    return found.select("conv_id", "origin", "text", "n_segments", "title", "source_metadata")
