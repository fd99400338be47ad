"""Batches of hybrid searches: vector and keyword rankings fused per question."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.json import json_contains
from dealweave.functions.text import query_text_key
from dealweave.operators.postings import Analyzer, keyword_search, plain_tokens, query_terms
from dealweave.operators.rows import top_k_per
from dealweave.operators.vectors import vector_top_k
from dealweave.plans.documents import LEARNED_KINDS
from dealweave.session import materialised

# Weights of the fused score and the memory threshold.
RANK_OFFSET = 60
VECTOR_WEIGHT = 1.3
MEMORY_SIMILARITY = 0.78
CONTEXT_KINDS = ("deal", "call_summary", "call_notes", "founder", "alumni_pattern", "funding_round")


def allowed(docs: DataFrame, kinds: Sequence[str] | None, metadata: dict | None) -> DataFrame:
    """Documents a search may return; applied before any candidate is cut."""
    if kinds is not None:
        docs = docs.filter(F.col("kind").isin(*kinds))
    if metadata is not None:
        docs = docs.filter(json_contains("metadata", metadata))
    return docs


def fused_score(vector_rank: Column, keyword_rank: Column) -> Column:
    """Reciprocal rank fusion with more weight on the vector side; a missing side adds nothing."""
    vector = F.coalesce(F.lit(VECTOR_WEIGHT) / (F.lit(float(RANK_OFFSET)) + vector_rank), F.lit(0.0))
    keyword = F.coalesce(F.lit(1.0) / (F.lit(float(RANK_OFFSET)) + keyword_rank), F.lit(0.0))
    return vector + keyword


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Both rankings side by side with the fused score; hits of one side only are kept."""
    v = vector_hits.select("query_id", "id", "similarity", F.col("rank").alias("vector_rank"))
    t = keyword_hits.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    both = v.join(t, ["query_id", "id"], "full")
    return both.withColumn("score", F.round(fused_score(F.col("vector_rank"), F.col("keyword_rank")), 9))


def _with_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The found rows with their documents. The rows, a few per question, are written so that Spark knows how few they
    are: it then reads the documents where they lie instead of shuffling all texts to find those of a few ids."""
    return materialised(found).join(docs.select("id", "kind", "title", F.col("body").alias("snippet"), "metadata"), "id")


def _ranked(queries: DataFrame, docs: DataFrame, vectors: DataFrame, posts: DataFrame, k: int, candidates: int,
            kinds: Sequence[str] | None = None, metadata: dict | None = None, analyzer: Analyzer = plain_tokens) -> DataFrame:
    """``hybrid_search`` without the documents."""
    searchable = allowed(docs, kinds, metadata)
    there = searchable.select("id")  # a stale vector or posting must not take a candidate's place
    vector_hits = vector_top_k(
        queries.filter(F.col("vector").isNotNull()), vectors.join(there, "id", "left_semi"), candidates)
    terms = query_terms(queries, "query_id", "text", analyzer=analyzer)
    # looked up by the ids of a share of the documents: postings lie by id and need no sort
    stored = posts.join(there.hint("shuffle_hash"), "id", "left_semi")
    fused = fuse(vector_hits, keyword_search(terms, stored, candidates))
    return top_k_per(fused, ["query_id"], [F.col("score").desc(), F.col("id")], k, rank="position")


def hybrid_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame, posts: DataFrame, k: int, candidates: int,
                  kinds: Sequence[str] | None = None, metadata: dict | None = None,
                  analyzer: Analyzer = plain_tokens) -> DataFrame:
    """The k best documents per question, with their whole text.

    Each ranking hands its ``candidates`` best per question to the fusion; every word of a question is searched for.

    ``queries`` has query_id, text and vector; ``docs`` id, kind, title, body, metadata; ``vectors`` id, kind,
    metadata, embedding; ``posts`` the postings, made with the same ``analyzer``.
    """
    return _with_documents(_ranked(queries, docs, vectors, posts, k, candidates, kinds, metadata, analyzer), docs)


def similar_items(ids: DataFrame, vectors: DataFrame, docs: DataFrame, k: int,
                  kinds: Sequence[str] | None = None) -> DataFrame:
    """More like this: the k nearest other documents of every stored id."""
    wanted = ids.select(F.col("id").alias("query_id")).distinct()
    queries = vectors.join(wanted, vectors["id"] == wanted["query_id"]).select(
        "query_id", F.col("embedding").alias("vector"))
    near = vector_top_k(queries, allowed(vectors, kinds, None), k, exclude_self=True)
    return _with_documents(near, docs)


def memory_context(queries: DataFrame, docs: DataFrame, vectors: DataFrame, posts: DataFrame, k: int, memory_k: int,
                   candidates: int, hit_kinds: Sequence[str] = CONTEXT_KINDS,
                   memory_kinds: Sequence[str] = LEARNED_KINDS,
                   min_similarity: float = MEMORY_SIMILARITY) -> DataFrame:
    """Per question: close memories and document hits, as arrays in the order shown.

    The rules that hold for every question are a result of their own (``plans.documents.newest_rules``), a row each:
    there may be more of them than a cell holds.
    """
    # Both searches are written in one job, which deals the texts for the postings once, and read the documents once.
    sides = {"memory": (memory_k, candidates, memory_kinds), "hits": (k, candidates, hit_kinds)}
    ranked = [_ranked(queries, docs, vectors, posts, *of).withColumn("_side", F.lit(side)) for side, of in sides.items()]
    found = _with_documents(ranked[0].unionByName(ranked[1]), docs)
    memory = found.filter((F.col("_side") == "memory") & (F.coalesce("similarity", F.lit(0.0)) >= min_similarity))
    memory = memory.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "id", "kind", "title", F.col("snippet").alias("text"),
        F.round("similarity", 3).alias("similarity")))).alias("memory"))
    hits = found.filter(F.col("_side") == "hits").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "id", "kind", F.coalesce(F.get_json_object("metadata", "$.name"), "title").alias("name"),
        F.get_json_object("metadata", "$.status").alias("status"),
        F.get_json_object("metadata", "$.meeting_date").alias("meeting_date"),
        "snippet"))).alias("hits"))
    return queries.select("query_id").join(memory, "query_id", "left").join(hits, "query_id", "left")


# --- embeddings ------------------------------------------------------------------------------------------------

Embedder = Callable[[pd.Series], pd.Series]
HASH_DIMENSIONS = 64


def hashed_words(texts: pd.Series) -> pd.Series:
    """Stand-in embedder: signed hashed word counts of unit length, the same on every machine.

    A real model is plugged in as another function of the same shape.
    """
    import xxhash

    def embed(text: str | None) -> list[float]:
        vector = np.zeros(HASH_DIMENSIONS)
        for word in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(word)
            vector[h % HASH_DIMENSIONS] += 1.0 if (h >> 32) & 1 else -1.0
        norm = np.sqrt((vector * vector).sum())
        return (vector / norm if norm else vector).tolist()

    return texts.map(embed)


def _embed(df: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield embedder(batch)

    return df.withColumn(out, run(F.col(text)))


def embed_pending(docs: DataFrame, as_of: Column, embedder: Embedder = hashed_words) -> DataFrame:
    """Documents with their missing embeddings filled from title and whole body; existing ones never reach Python."""
    pending = docs.filter(F.col("embedding").isNull()).withColumn("_text", F.concat_ws("\n", "title", "body"))
    done = _embed(pending.drop("embedding"), "_text", "embedding", embedder).withColumn("embedded_at", as_of)
    return docs.filter(F.col("embedding").isNotNull()).unionByName(done.select(*docs.columns))


def embed_queries(queries: DataFrame, cache: DataFrame, as_of: Column, keep_days: int = 30,
                  embedder: Embedder = hashed_words) -> tuple[DataFrame, DataFrame]:
    """Vectors for all questions and the new cache state (q, embedding, used_at).

    Each distinct normalised question is embedded once; cached ones are only touched. Entries unused for
    ``keep_days`` leave the cache.
    """
    keyed = queries.withColumn("q", query_text_key("text"))
    wanted = keyed.groupBy("q").agg(F.min("text").alias("text"))
    missing = wanted.join(cache, "q", "left_anti").withColumn("_text", F.col("text"))
    fresh = _embed(missing, "_text", "embedding", embedder).select("q", "embedding", as_of.alias("used_at"))
    stale_touch = F.col("used_at") < as_of - F.make_dt_interval(F.lit(1))
    held = cache.join(wanted.select("q", F.lit(True).alias("_asked")), "q", "left").withColumn(
        "used_at", F.when(F.col("_asked") & stale_touch, as_of).otherwise(F.col("used_at"))).drop("_asked")
    state = held.select("q", "embedding", "used_at").unionByName(fresh)
    kept = state.filter(F.col("used_at") >= as_of - F.make_dt_interval(F.lit(keep_days)))
    answered = keyed.join(state.select("q", F.col("embedding").alias("vector")), "q", "left").drop("q")
    return answered, kept
