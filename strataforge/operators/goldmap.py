"""Mapping quoted evidence to chunks: exact, compact, fragments, unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import compact_form, evidence_form, token_fragments


def containing(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(evidence_id, chunk_id, how, hits): chunks on the evidence's page that hold its text.

    evidence(evidence_id, page, span) and chunks(chunk_id, page, content) meet by page only, never across pages. how is exact, compact or
    fragment, the strongest that holds; hits counts the fragments found. Null pages meet nothing; empty spans match nothing.
    """
    left = evidence.select("evidence_id", F.col("page").alias("p"), evidence_form(F.col("span")).alias("e"), compact_form(F.col("span")).alias("ec"), token_fragments(F.col("span")).alias("fragments"))
    right = chunks.select("chunk_id", F.col("page").alias("q"), evidence_form(F.col("content")).alias("c"), compact_form(F.col("content")).alias("cc"))
    joined = left.join(right, F.col("p") == F.col("q"))
    hits = F.size(F.filter("fragments", lambda f: (f != "") & F.contains(F.col("c"), f)))
    exact = (F.col("e") != "") & F.contains(F.col("c"), F.col("e"))
    compact = (F.col("ec") != "") & F.contains(F.col("cc"), F.col("ec"))
    how = F.when(exact, "exact").when(compact, "compact").when(hits > 0, "fragment")
    return joined.select("evidence_id", "chunk_id", how.alias("how"), hits.alias("hits")).where("how is not null")


def classify(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """(evidence_id, status, chunk_id): exact with its one chunk, ambiguous, candidate or unresolved.

    Compact matches only count where no exact one exists, fragments only where neither does.
    """
    counts = found.groupBy("evidence_id").agg(*[F.count(F.when(F.col("how") == h, 1)).alias(h) for h in ("exact", "compact", "fragment")], *[F.min(F.when(F.col("how") == h, F.col("chunk_id"))).alias(f"{h}_id") for h in ("exact", "compact")])
    joined = evidence.select("evidence_id").distinct().join(counts, "evidence_id", "left")
    exact, compact = F.coalesce("exact", F.lit(0)), F.coalesce("compact", F.lit(0))
    status = F.when(exact == 1, "exact").when(exact > 1, "ambiguous").when(compact == 1, "exact").when(compact > 1, "ambiguous").when(F.coalesce("fragment", F.lit(0)) > 0, "candidate").otherwise("unresolved")
    chunk = F.when(exact == 1, F.col("exact_id")).when((exact == 0) & (compact == 1), F.col("compact_id"))
    return joined.select("evidence_id", status.alias("status"), chunk.alias("chunk_id"))
