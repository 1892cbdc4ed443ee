"""Reciprocal-rank fusion, hybrid search and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.text import lexical_tokens
from strataforge.operators.lexical import top

# Fixed value: the usual constant of reciprocal-rank fusion.
RRF_K = 60


def fuse(ranked: DataFrame, k: int = RRF_K, top_k: int | None = None, channel: str = "rrf") -> DataFrame:
    """(query_id, channel, chunk_id, score, rank): sum of 1 / (k + rank) over all rows of a chunk.

    ``ranked`` is the union of the lists. A chunk twice in one list counts twice; rows with a null rank count nothing. One aggregation
    does the merge, no join. Raises ValueError unless k is positive.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    summed = ranked.where("rank is not null").groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return top(summed, top_k).select("query_id", F.lit(channel).alias("channel"), "chunk_id", "score", "rank")


def sweep(ranked: DataFrame, ks: list[int], top_k: int | None = None) -> DataFrame:
    """The fused lists for several constants at once, with the column k: one scan and one aggregation."""
    if any(k <= 0 for k in ks):
        raise ValueError("k must be positive")
    spread = ranked.where("rank is not null").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    summed = spread.groupBy("k", "query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 9).alias("score"))
    out = summed.withColumn("rank", F.row_number().over(Window.partitionBy("k", "query_id").orderBy(F.col("score").desc(), "chunk_id")))
    return out if top_k is None else out.where(F.col("rank") <= max(top_k, 0))


def hybrid(dense: DataFrame, sparse: DataFrame, top_k: int = 20, candidate_k: int = 20, k: int = RRF_K) -> DataFrame:
    """Both lists cut at ``candidate_k`` and fused to ``top_k``."""
    columns = ["query_id", "channel", "chunk_id", "score", "rank"]
    lists = dense.select(*columns).unionByName(sparse.select(*columns)).where(F.col("rank") <= max(candidate_k, 0))
    return fuse(lists, k, top_k)


def overlap(question: Column, content: Column) -> Column:
    """The default scorer: Jaccard similarity of the token sets, 0 when both are empty."""
    a, b = lexical_tokens(question), lexical_tokens(content)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """The list rescored by (question, content): score descending, then the previous rank; the first k; k <= 0 gives none."""
    texts = chunks.select("chunk_id", "content").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("content").alias("content"))
    joined = ranked.select("query_id", "chunk_id", F.col("rank").alias("previous")).join(queries.select("query_id", "question"), "query_id").join(texts, "chunk_id")
    scored = joined.select("query_id", "chunk_id", "previous", F.round(scorer(F.col("question"), F.col("content")), 9).alias("score"))
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "previous", "chunk_id")))
    return placed.where(F.col("rank") <= max(k, 0)).select("query_id", F.lit("reranker").alias("channel"), "chunk_id", "score", "rank")
