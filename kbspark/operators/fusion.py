"""Rank fusion, re-ranking and the retrieval composition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import K_BM25, K_EMB, K_RERANK, RRF_C
from . import bm25, knn


def ranked(hits: DataFrame, score: str, keys: tuple[str, ...] = ("query_id",), tie: str = "doc_id") -> DataFrame:
    """1-based rank of every hit within its query."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))


def reciprocal_rank_fusion(lists: dict[str, DataFrame], c: int = RRF_C) -> DataFrame:
    """Sum of 1/(rank+c) over ranked lists of (query_id, doc_id, rank).

    Equal scores keep the order of the first list, then of the next ones, then the id.
    """
    names = list(lists)
    rows = None
    for name, hits in lists.items():
        part = hits.select("query_id", "doc_id", "rank", F.lit(name).alias("_list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (F.col("rank") + c)).alias("score"),
        *[F.min(F.when(F.col("_list") == n, F.col("rank"))).alias(f"{n}_rank") for n in names],
    )
    fused = fused.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(f"{n}_rank").asc_nulls_last() for n in names], "doc_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def union_hits(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """One payload per (query, document); the preferred list's copy wins."""
    rows = preferred.withColumn("_source", F.lit(0)).unionByName(other.withColumn("_source", F.lit(1)))
    payload = [c for c in preferred.columns if c not in ("query_id", "doc_id")]
    picked = rows.groupBy("query_id", "doc_id").agg(F.min_by(F.struct(*payload), "_source").alias("p"))
    return picked.select("query_id", "doc_id", "p.*")


def no_match(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries the vector search found nothing for."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


# --- re-ranking ----------------------------------------------------------------------------------------------

Reranker = Callable[[Column, Column], Column]
RERANKERS: dict[str, Reranker] = {}


def register_reranker(name: str, scorer: Reranker) -> None:
    """Add a scorer: (query text, document text) columns to a score column, e.g. a pandas UDF around a model."""
    RERANKERS[name] = scorer


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the distinct query tokens that the document holds."""
    from ..functions.text import tokens

    wanted = F.array_distinct(tokens(query))
    found = F.size(F.array_intersect(wanted, tokens(text)))
    return F.round(found / F.greatest(F.size(wanted), F.lit(1)), 6)


register_reranker("token_overlap", token_overlap)


def rerank(hits: DataFrame, k: int = K_RERANK, model: str = "token_overlap") -> DataFrame:
    """Order (query_id, doc_id, query, text, rank) by the model's score and keep ``k``; ties keep the old order."""
    scored = hits.withColumn("rerank_score", RERANKERS[model](F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order).cast("long")).where(F.col("new_rank") <= k)


def rerank_by_answer(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Order hits by the product of their vector with the answer's vector; without an answer the order stays."""
    from ..functions.vectors import dot

    joined = hits.join(answers.select("query_id", F.col("vector").alias("_answer")), "query_id", "left")
    scored = joined.withColumn("answer_score", F.when(F.col("_answer").isNotNull(), F.round(dot("vector", "_answer"), 6)))
    order = Window.partitionBy("query_id").orderBy(F.col("answer_score").desc_nulls_last(), "rank", "doc_id")
    return scored.withColumn("new_rank", F.row_number().over(order).cast("long")).drop("_answer")


# --- composition ---------------------------------------------------------------------------------------------


def context_text(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Documents of every query joined by a blank line in rank order (hits are already cut to k)."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text")))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("context"))


def retrieve(
    text_queries: DataFrame,
    vector_queries: DataFrame,
    chunks: DataFrame,
    by: tuple[str, ...] = (),
    k_bm25: int = K_BM25,
    k_emb: int = K_EMB,
    reranker: str | None = None,
    k_rerank: int = K_RERANK,
) -> DataFrame:
    """Vector and text search of a table of queries, fused and optionally re-ranked.

    ``chunks`` has doc_id, text, vector and the ``by`` columns; a query only sees rows with its own ``by`` values.
    """
    text_hits = bm25.search(text_queries, chunks.drop("vector"), by=by, k=k_bm25)
    vector_hits = knn.search(vector_queries, chunks.drop("text"), by=by, k=k_emb)
    fused = reciprocal_rank_fusion({"cosine": vector_hits, "bm25": text_hits})
    if reranker is None:
        return fused
    payload = fused.join(chunks.select("doc_id", "text"), "doc_id").join(
        text_queries.select("query_id", F.col("text").alias("query")), "query_id"
    )
    return rerank(payload, k_rerank, reranker)
