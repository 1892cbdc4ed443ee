"""The retrieval pipeline: two channels, fusion, filters, rerank or slice, with its trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.eligibility import filter_metadata, structurally_eligible
from strataforge.operators.fusion import RRF_K, fuse

_COLUMNS = ["query_id", "channel", "chunk_id", "score", "rank"]


def run(
    dense: DataFrame,
    sparse: DataFrame,
    chunks: DataFrame,
    dense_k: int = 20,
    sparse_k: int = 20,
    rerank_k: int = 5,
    rrf_k: int = RRF_K,
    structural: bool = True,
    metadata: dict[str, list[str] | None] | None = None,
    reranker: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The stages dense, bm25, rrf, structural, metadata and final, each (query_id, channel, chunk_id, score, rank).

    Filters work on the fused list after it is cut to max(dense_k, sparse_k), so fewer than rerank_k rows may remain. Without a
    reranker the final stage is the first rerank_k rows of the filtered list with their ranks unchanged.
    """
    a = dense.where(F.col("rank") <= max(dense_k, 0)).select(*_COLUMNS)
    b = sparse.where(F.col("rank") <= max(sparse_k, 0)).select(*_COLUMNS)
    fused = fuse(a.unionByName(b), rrf_k, max(dense_k, sparse_k, 0))
    kept = structurally_eligible(fused, chunks) if structural else fused
    chosen = filter_metadata(kept, chunks, metadata) if metadata else kept
    if reranker:
        final = reranker(chosen)
    else:
        order = Window.partitionBy("query_id").orderBy("rank")
        final = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(rerank_k, 0)).drop("_n")
    return {"dense": a, "bm25": b, "rrf": fused, "structural": kept.select(*_COLUMNS), "metadata": chosen.select(*_COLUMNS), "final": final.select(*_COLUMNS)}


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """All stages in one table with the column ``stage``."""
    out = None
    for name, rows in stages.items():
        part = rows.select(F.lit(name).alias("stage"), *_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out
