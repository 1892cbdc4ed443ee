"""Graded evaluation of ranked lists, and how two retrievers complement each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs, the grade from which a chunk is relevant, the depth of nDCG and of the complementarity analysis.
CUTOFFS = (1, 5, 10, 20)
RELEVANT = 2
NDCG_DEPTH = 5
DEPTH = 20


def best_grades(gold: DataFrame) -> DataFrame:
    """(query_id, chunk_id, grade): the highest grade of each pair, positive ones only."""
    return gold.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade")).where("grade > 0")


def missing_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of gold chunks that the corpus lacks."""
    return gold.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("query_id", "chunk_id")


def require_gold(gold: DataFrame, chunks: DataFrame) -> None:
    """Raises ValueError naming up to 20 questions whose gold the corpus lacks."""
    lost = missing_gold(gold, chunks).groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("ids")).orderBy("query_id").limit(20).collect()
    if lost:
        raise ValueError("gold evidence is missing: " + "; ".join(f"{r['query_id']}: {', '.join(r['ids'][:5])}" for r in lost))


def per_query(results: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per question: query_id, category, answerable, hit_1, hit_5, hit_10, hit_20, mrr, ndcg_5.

    A question without results or gold gets zeros; a chunk twice in a list counts at its first rank.
    """
    grades = best_grades(gold)
    first = results.where("rank is not null").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    judged = first.join(grades, ["query_id", "chunk_id"])
    relevant = F.when(F.col("grade") >= RELEVANT, F.col("rank"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    sums = judged.groupBy("query_id").agg(F.min(relevant).alias("first"), F.sum(F.when(F.col("rank") <= NDCG_DEPTH, gain).otherwise(0.0)).alias("dcg"))
    place = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "chunk_id")
    ideal = grades.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= NDCG_DEPTH).groupBy("query_id").agg(F.sum(gain).alias("ideal"))
    joined = questions.select("query_id", "category", "answerable").join(sums, "query_id", "left").join(ideal, "query_id", "left")
    hits = [F.when(F.col("first") <= c, 1.0).otherwise(0.0).alias(f"hit_{c}") for c in CUTOFFS]
    ndcg = F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return joined.select("query_id", "category", "answerable", *hits, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("mrr"), F.round(ndcg, 9).alias("ndcg_5"))


def overall(measured: DataFrame) -> DataFrame:
    """Means over the answerable questions; zeros when there are none."""
    names = [f"hit_{c}" for c in CUTOFFS] + ["mrr", "ndcg_5"]
    return measured.where("answerable").agg(F.count("*").alias("questions"), *[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 9).alias(n) for n in names])


def by_category(measured: DataFrame) -> DataFrame:
    """Means over all questions of a category; zeros for one without an answerable question."""
    names = [f"hit_{c}" for c in CUTOFFS] + ["mrr", "ndcg_5"]
    grouped = measured.groupBy("category").agg(F.count("*").alias("questions"), F.max(F.col("answerable").cast("int")).alias("any"), *[F.avg(n).alias(n) for n in names])
    return grouped.select("category", "questions", *[F.round(F.when(F.col("any") == 1, F.col(n)).otherwise(0.0), 9).alias(n) for n in names])


def _candidates(results: DataFrame, name: str, depth: int) -> DataFrame:
    return results.where(F.col("rank") <= depth).groupBy("query_id").agg(F.collect_set("chunk_id").alias(name))  # at most ``depth`` ids


def _gold_rank(results: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    relevant = best_grades(gold).where(F.col("grade") >= RELEVANT)
    return results.join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias(name))


def complementarity(dense: DataFrame, sparse: DataFrame, hybrid: DataFrame, questions: DataFrame, gold: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per answerable question: candidate overlap of two retrievers and who finds relevant evidence.

    classification is both, dense_only, bm25_only or neither; a rescue is a question that only the other channel hits and the hybrid hits too.
    """
    base = questions.where("answerable").select("query_id")
    for results, name in ((dense, "d"), (sparse, "b")):
        base = base.join(_candidates(results, name, depth), "query_id", "left")
    for results, name in ((dense, "dense_gold_rank"), (sparse, "bm25_gold_rank"), (hybrid, "hybrid_gold_rank")):
        base = base.join(_gold_rank(results.where(F.col("rank") <= depth), gold, name), "query_id", "left")
    none = F.array().cast("array<string>")
    d, b = F.coalesce("d", none), F.coalesce("b", none)
    both, union = F.size(F.array_intersect(d, b)), F.size(F.array_union(d, b))
    hit_d, hit_b, hit_h = (F.col(c).isNotNull() for c in ("dense_gold_rank", "bm25_gold_rank", "hybrid_gold_rank"))
    kind = F.when(hit_d & hit_b, "both").when(hit_d, "dense_only").when(hit_b, "bm25_only").otherwise("neither")
    rescue = F.when(hit_h & hit_b & ~hit_d, "bm25_rescued_dense").when(hit_h & hit_d & ~hit_b, "dense_rescued_bm25")
    sizes = [F.size(d).alias("dense_count"), F.size(b).alias("bm25_count"), both.alias("intersection"), union.alias("union_count")]
    jaccard = F.round(F.when(union == 0, 0.0).otherwise(both / union), 9).alias("jaccard")
    alone = [(F.size(d) - both).alias("unique_dense"), (F.size(b) - both).alias("unique_bm25")]
    return base.select("query_id", *sizes, jaccard, *alone, "dense_gold_rank", "bm25_gold_rank", "hybrid_gold_rank", kind.alias("classification"), rescue.alias("rescue"))


def complementarity_summary(rows: DataFrame) -> DataFrame:
    """One row: counts by classification and rescue, means and medians of overlap; zeros when empty."""
    counts = [F.count(F.when(F.col("classification") == c, 1)).alias(c) for c in ("both", "dense_only", "bm25_only", "neither")]
    counts += [F.count(F.when(F.col("rescue") == c, 1)).alias(c) for c in ("bm25_rescued_dense", "dense_rescued_bm25")]
    stats = [F.round(F.coalesce(f(c), F.lit(0.0)), 9).alias(f"{n}_{c}") for c in ("intersection", "jaccard") for n, f in (("mean", F.avg), ("median", F.median))]
    stats += [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(f"mean_{c}") for c in ("unique_dense", "unique_bm25")]
    return rows.agg(F.count("*").alias("questions"), *counts, *stats)


def require_same_questions(reports: list[DataFrame]) -> None:
    """Raises ValueError when reports differ in their questions or name one twice."""
    first = reports[0].select("query_id")
    for report in reports:
        if report.groupBy("query_id").count().where("count > 1").limit(1).count():
            raise ValueError("a report names a question twice")
    for other in reports[1:]:
        one, two = first.distinct(), other.select("query_id").distinct()
        if one.join(two, "query_id", "left_anti").limit(1).count() or two.join(one, "query_id", "left_anti").limit(1).count():
            raise ValueError("reports hold different questions")
