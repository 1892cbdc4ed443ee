"""Problem 3: one ranking from several differently-scaled scores.

Scores become ranks within their query and channel, scaled to (0, 1] (1 = best, an absent channel gives 0), so
range and distribution of a score no longer matter. The first principal component of the
channels' correlation matrix, computed in one distributed aggregation of d*(d+3)/2 sums, gives the
loadings; its sign is oriented to the declared directions, and items are sorted by their projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.session import written

#: Channel to direction: 1 where a higher score is better, -1 where a lower one is.
DIRECTIONS = {"dense": 1, "bm25": 1, "rerank": 1, "usage": 1, "l2": -1}
#: Rows of a group from which on its order is made by ranges instead of in one task.
HOT = 1_000_000


def latest(ranked: DataFrame, directions: dict[str, int]) -> DataFrame:
    """One row per (query_id, channel, chunk_id): the newest delivery that has a score, else the newest.

    Rows with a null key or an undeclared channel are left out; a NaN score counts as null.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    rows = ranked.where("query_id is not null and chunk_id is not null").where(F.col("channel").isin(*directions))
    best = F.max(F.struct(score.isNotNull().alias("has"), F.col("recorded_at"), score.alias("score"), F.col("rank").alias("rank")))
    return rows.groupBy("query_id", "channel", "chunk_id").agg(best.alias("b"), F.min("rank").alias("any_rank")).select("query_id", "channel", "chunk_id", "b.score", F.coalesce("b.rank", "any_rank").alias("rank"))


def running(rows: DataFrame, group: list[str], order: list, weight) -> DataFrame:  # noqa: ANN001
    """Adds ``before``: the sum of ``weight`` over the rows of the group that come earlier in ``order`` (which has no ties).

    A group of any size is spread over ranges of the order; the sums of the ranges before give each range its offset.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_w", weight.cast("bigint")).repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id())
    placed = written(ranged, "ranges")
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    sums = placed.groupBy(*group, "_range").agg(F.sum("_w").alias("_n"))
    offsets = sums.select(*group, "_range", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).alias("_offset"))
    local = placed.withColumn("_upto", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(offsets, [*group, "_range"]).withColumn("before", F.col("_offset") + F.col("_upto") - F.col("_w")).drop("_w", "_range", "_upto", "_offset")


def parted(rows: DataFrame, group: list[str], hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to ``hot`` rows, the other rows or None where there are none)."""
    large = written(rows.groupBy(*group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot).select(*group), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, group, "left_anti"), rows.join(large, group, "left_semi")


def rank_transform(ranked: DataFrame, directions: dict[str, int] = DIRECTIONS, hot: int = HOT) -> DataFrame:
    """(query_id, channel, chunk_id, value): the rank within query and channel, scaled to (0, 1].

    Ties share their mean rank. A row without score takes its delivered rank; one with neither is last
    (value 0). One window gives rank, ties and size. A list of more than ``hot`` rows is first added up by distinct
    score, so a tie is one row, and these are ranked by ranges, so no task sorts the whole list.
    """
    sign = F.lit(0.0)
    for channel, direction in directions.items():
        sign = F.when(F.col("channel") == channel, F.lit(float(direction))).otherwise(sign)
    group = ["query_id", "channel"]
    plain, large = parted(latest(ranked, directions).withColumn("directed", F.col("score") * sign), group, hot)
    inside = Window.partitionBy(*group).orderBy(F.col("directed").desc_nulls_last())
    tied, whole = Window.partitionBy(*group, "directed"), Window.partitionBy(*group)
    at = F.when(F.col("directed").isNull(), F.col("rank").cast("double")).otherwise(F.rank().over(inside) + (F.count("*").over(tied) - 1) / 2)
    placed = plain.withColumn("at", at).withColumn("size", F.count("*").over(whole)).select(*group, "chunk_id", "at", "size")
    if large is not None:
        scores = large.where("directed is not null").groupBy(*group, "directed").agg(F.count("*").alias("n"))
        ordered = running(scores, group, [F.col("directed").desc()], F.col("n")).select(*group, "directed", (F.col("before") + (F.col("n") + 1) / 2).alias("place"))
        sizes = large.groupBy(*group).agg(F.count("*").alias("size"))
        found = large.join(ordered, [*group, "directed"], "left").join(sizes, group)
        placed = placed.unionByName(found.select(*group, "chunk_id", F.coalesce("place", F.col("rank").cast("double")).alias("at"), "size"))
    value = F.greatest(F.lit(0.0), F.coalesce((F.col("size") - F.col("at") + 1) / F.col("size"), F.lit(0.0)))
    return placed.select(*group, "chunk_id", F.least(F.lit(1.0), value).alias("value"))


def wide(values: DataFrame, channels: list[str]) -> DataFrame:
    """(query_id, chunk_id, one column c0.. per channel); an absent channel is 0."""
    columns = [F.coalesce(F.max(F.when(F.col("channel") == c, F.col("value"))), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(channels)]
    return values.groupBy("query_id", "chunk_id").agg(*columns)


def principal_component(table: DataFrame, size: int) -> tuple[list[float], list[float], list[float]]:
    """(means, deviations, loadings) of the first principal component of columns c0..c{size-1}.

    One aggregation to the driver: size*(size+3)/2 + 1 numbers, whatever the number of rows. Constant columns get
    deviation 1; with no correlation at all (or no rows) the loadings are equal. The sign is oriented so
    that the loadings, whose columns all point to "better", sum to a positive number. A channel whose loading still opposes its declared
    direction would reward bad scores: it is left out and the component is taken of the others again.
    """
    sums = [F.sum(f"c{i}") for i in range(size)] + [F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(size) for j in range(i, size)]
    row = list(table.agg(F.count("*"), *sums).first())
    n = row[0]
    equal = [1 / size**0.5] * size
    if not n:
        return [0.0] * size, [1.0] * size, equal
    mean = np.array(row[1 : size + 1]) / n
    cov, k = np.zeros((size, size)), size + 1
    for i in range(size):
        for j in range(i, size):
            cov[i, j] = cov[j, i] = row[k] / n - mean[i] * mean[j]
            k += 1
    deviation = np.sqrt(np.clip(np.diag(cov), 0, None))
    deviation[deviation < 1e-9] = 1.0
    correlation = cov / np.outer(deviation, deviation)
    kept = np.arange(size)
    while True:
        _, vectors = np.linalg.eigh(correlation[np.ix_(kept, kept)])
        part = vectors[:, -1]
        part = part if part.sum() > 0 else -part
        if (part >= 0).all() or len(kept) == 1:
            break
        kept = kept[part >= 0]
    if not np.abs(correlation - np.diag(np.diag(correlation))).max(initial=0) > 1e-12:
        return mean.tolist(), deviation.tolist(), equal
    loading = np.zeros(size)
    loading[kept] = np.abs(part)
    return mean.round(9).tolist(), deviation.round(9).tolist(), loading.round(6).tolist()


def fuse(ranked: DataFrame, directions: dict[str, int] = DIRECTIONS) -> DataFrame:
    """(query_id, chunk_id, projection, channels, value_<channel>...): every chunk of every query with its projection.

    Columns are standardised before the component is taken, so every channel enters with the same weight; the
    loadings then differ only as far as a channel disagrees with the others. An empty table gives an empty
    result. Columns of the input beyond the six read are ignored.
    """
    channels = list(directions)
    table = written(wide(rank_transform(ranked, directions), channels), "wide")
    _, deviation, loading = principal_component(table, len(channels))
    # An absent channel gains nothing: the projection has its zero at "absent", not at the mean.
    projection = sum((F.col(f"c{i}") * F.lit(loading[i] / deviation[i]) for i in range(len(channels))), F.lit(0.0))
    present = sum((F.when(F.col(f"c{i}") > 0, 1).otherwise(0) for i in range(len(channels))), F.lit(0))
    return table.select("query_id", "chunk_id", F.round(projection, 9).alias("projection"), present.alias("channels"), *[F.col(f"c{i}").alias(f"value_{c}") for i, c in enumerate(channels)])


def order(fused: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds ``position`` (1 = first) within each query; a query of more than ``hot`` chunks is ordered by ranges."""
    by = [F.col("projection").desc(), F.col("chunk_id")]
    plain, large = parted(fused, ["query_id"], hot)
    placed = plain.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    if large is None:
        return placed
    return placed.unionByName(running(large, ["query_id"], by, F.lit(1)).withColumn("position", (F.col("before") + 1).cast("int")).drop("before"))


def leaders(fused: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the first of each query, by an aggregation that combines before it shuffles.

    Ties go to the smaller chunk_id, as in ``order``.
    """
    first = F.min(F.struct((-F.col("projection")).alias("p"), F.col("chunk_id")))
    return fused.groupBy("query_id").agg(first.alias("f")).select("query_id", F.col("f.chunk_id").alias("chunk_id"))
