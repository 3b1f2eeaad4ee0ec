"""Keyword, vector and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainery.functions import text as X
from grainery.operators import index
from grainery.sources import providers, shared

# fixed values: BM25's parameters, the floor of a term's weight, the fusion constant
K1, B, IDF_FLOOR, RRF_K = 1.2, 0.75, 1e-6, 60


def pool_size(limit: int) -> int:
    return max(5 * limit, 50)


def query_terms(query: str, terms: list[str] | None = None, strict: bool = False) -> list[list[str]] | None:
    """The phrases of a query, each a list of tokens; None if the strict grammar refuses it.

    A term with an inner underscore is a phrase; one with an inner hyphen is refused in
    strict mode and is otherwise split in two.
    """
    import re
    import unicodedata

    given = terms or query.split()
    cleaned = [re.sub(r"[^\w-]", "", t).strip("-_").lower() for t in given]
    cleaned = [t for t in dict.fromkeys(cleaned) if t]
    if strict and any("-" in t for t in cleaned):
        return None
    folded = ["".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in cleaned]
    phrases = [[w for w in re.split(r"[_\W]+", p) if w] for t in folded for p in t.split("-")]
    return [list(p) for p in dict.fromkeys(tuple(p) for p in phrases if p)]


def _frequency(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a token list."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    steps = F.sequence(F.lit(1), F.size(tokens) - len(phrase) + 1)
    same = F.filter(steps, lambda i: F.slice(tokens, i, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.when(F.size(tokens) >= len(phrase), F.size(same)).otherwise(0)


def bm25(rows: DataFrame, phrases: list[list[str]], mode: str = "relaxed") -> DataFrame:
    """id, score of rows(id, tokens) that hold all phrases (`and`), any (`or`), or any only where no row has all (`relaxed`).

    Only the query's terms are counted, in one pass over the texts whose counts, a small row for each text, are
    written to the shared folder; the corpus' figures (a single row, broadcast) and the scores are read from
    them. No postings are shuffled.
    """
    spark = rows.sparkSession
    if not phrases:
        return spark.createDataFrame([], "id bigint, score double")
    tf = [f"tf{i}" for i in range(len(phrases))]
    counted = rows.select("id", F.size("tokens").alias("length"), *(_frequency(F.col("tokens"), p).alias(c) for p, c in zip(phrases, tf, strict=True)))
    counted = shared.materialize(counted, "bm25-counts")
    full = F.count(F.when(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tf]), 1))
    figures = counted.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"), full.alias("full"), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"df_{c}") for c in tf))
    hits = sum(((F.col(c) > 0).cast("int") for c in tf), F.lit(0))
    few = {"and": F.lit(len(tf)), "or": F.lit(1), "relaxed": F.when(F.col("full") > 0, len(tf)).otherwise(1)}[mode]
    found = counted.crossJoin(F.broadcast(figures)).filter(hits >= few)  # one row

    def part(c: str) -> Column:
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{c}") + 0.5) / (F.col(f"df_{c}") + 0.5)), F.lit(IDF_FLOOR))
        return idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * ((1 - B) + B * F.col("length") / F.col("avgdl")))

    return found.select("id", sum((part(c) for c in tf[1:]), part(tf[0])).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best with their rank, ties to the smaller id; the rank needs k rows only."""
    best = scored.orderBy(F.desc(score), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def cosine_scores(vectors: DataFrame, query: list[float], model: str | None = None) -> DataFrame:
    """id, score of vectors(id, embedding[, embedding_model]); null, zero and other models' vectors are left out."""
    rows = vectors.filter("embedding IS NOT NULL")
    rows = rows if model is None else rows.filter(F.col("embedding_model") == model)
    rows = rows.filter(F.size("embedding") == len(query)).withColumn("__norm", X.norm("embedding")).filter("__norm > 0")
    q = F.array(*(F.lit(float(x)) for x in query))
    length = sum(x * x for x in query) ** 0.5
    if not length:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    return rows.select("id", (X.dot("embedding", q) / (F.col("__norm") * F.lit(length))).alias("score"))


def fuse(keyword: DataFrame, vector: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """id, score, keyword_rank, vector_rank of two ranked lists (id, rank) by reciprocal rank; ties go by keyword rank, then vector rank."""
    both = keyword.select("id", F.col("rank").alias("keyword_rank"), F.lit(None).cast("int").alias("vector_rank")).unionByName(
        vector.select("id", F.lit(None).cast("int").alias("keyword_rank"), F.col("rank").alias("vector_rank"))
    )
    one = both.groupBy("id").agg(F.max("keyword_rank").alias("keyword_rank"), F.max("vector_rank").alias("vector_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = one.withColumn("score", share("keyword_rank") + share("vector_rank"))
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("vector_rank")).limit(limit)


def backend(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """One row: which side found anything."""
    sides = keyword.agg(F.count("*").alias("k")).crossJoin(vector.agg(F.count("*").alias("v")))  # one row each
    label = F.when((F.col("k") > 0) & (F.col("v") > 0), "hybrid").when(F.col("k") > 0, "fts_only").when(F.col("v") > 0, "vector_only").otherwise("none")
    return sides.select(label.alias("backend"))


def neighbours(hits: DataFrame, snippets: DataFrame) -> DataFrame:
    """hits(document_id, chunk_index, ...) with context_before and context_after: the excerpts at the next indices, never over a gap.

    Each excerpt is read once and sent to the places on both sides of it.
    """
    excerpts = snippets.filter("kind = 'excerpt' AND chunk_index IS NOT NULL").groupBy("document_id", "chunk_index").agg(F.min_by("content", "id").alias("content"))
    none = F.lit(None).cast("string")
    side = lambda by, before, after: F.struct((F.col("chunk_index") + by).alias("chunk_index"), before.alias("context_before"), after.alias("context_after"))
    sent = excerpts.select("document_id", F.inline(F.array(side(1, F.col("content"), none), side(-1, none, F.col("content")))))
    beside = sent.groupBy("document_id", "chunk_index").agg(F.max("context_before").alias("context_before"), F.max("context_after").alias("context_after"))
    return hits.join(beside, ["document_id", "chunk_index"], "left")


def results(ranked: DataFrame, snippets: DataFrame, documents: DataFrame) -> DataFrame:
    """ranked(id, score) with snippet, document and context: the search result's columns.

    ranked holds at most `limit` rows: it is broadcast, so neither table is shuffled for the hits. The hits are
    written once; what comes after reads them and, of the snippets, those of their documents.
    """
    hits = shared.materialize(snippets.join(F.broadcast(ranked.select("id", "score")), "id").select("id", "document_id", "kind", "content", "chunk_index", "score"), "hits")
    titled = F.broadcast(hits).join(documents.select(F.col("id").alias("document_id"), "title", "url", "ingested_at"), "document_id")
    near = neighbours(titled, snippets.join(F.broadcast(hits.select("document_id").distinct()), "document_id", "left_semi"))
    return near.select(
        F.col("id").alias("snippet_id"), "document_id", "kind", "content", "chunk_index", F.col("title").alias("document_title"), F.col("url").alias("document_url"),
        "ingested_at", "context_before", "context_after", "score",
    )


def query_vector(provider, query: str) -> list[float] | None:
    """The vector of a search string under the instruction for queries; null if the provider gives none, and keywords alone count."""
    found = providers.embedded(provider, [query], "query")
    return None if found is None else found[0]


def hybrid(snippets: DataFrame, documents: DataFrame, query: str, vector: list[float] | None, limit: int = 10, terms: list[str] | None = None, model: str | None = None, strict: bool = False) -> DataFrame:
    """Search by words and by meaning; either side may be empty, and without a vector only the words count."""
    if not query.strip():
        raise ValueError("empty query")
    pool = pool_size(limit)
    phrases = query_terms(query, terms, strict)
    keyword = top(bm25(index.tokenized(snippets), phrases or []), pool)
    meaning = top(cosine_scores(snippets.select("id", "embedding", "embedding_model"), vector or [], model), pool)
    return results(fuse(keyword, meaning, limit), snippets, documents)
