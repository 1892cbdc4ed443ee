"""Problem 9: mix sources to target weights with a low-discrepancy schedule.

Slot i of the mixture takes the source in whose cumulative weight the fraction of i times the golden ratio falls, so
every stretch of the mixture has the target shares up to a few slots. Each source's documents are shuffled by hash into one
stream, cut into blocks of equal tokens by a distributed prefix sum, repeated as often as the target needs
and the cap allows; the k-th block of a source goes to the k-th slot of that source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.llm.tokens import FILE, FOLDER, with_counts
from strataforge.session import written

BLOCK = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096


def plan(stock: dict[str, int], weights: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take from each listed source that occurs.

    Without ``total`` the largest mixture in which every occurring source reaches its share (shares of missing sources are
    spread in proportion); with it, a source that its cap keeps under its share gives all it may.
    """
    present = {s: (share, cap) for s, (share, cap) in weights.items() if stock.get(s, 0) > 0 and share > 0 and cap > 0}
    mass = sum(share for share, _ in present.values())
    if not present:
        return {}
    most = min(cap * stock[s] * mass / share for s, (share, cap) in present.items())
    size = most if total is None else total
    return {s: min(cap * stock[s], int(size * share / mass)) for s, (share, cap) in present.items()}


def slots_for(blocks: int, share: float) -> int:
    """Slots after which a source of this share has surely got ``blocks`` of them.

    Of N golden-ratio points an interval of length w holds at least wN - 3 - (1 / ln g + 1 / ln 2) ln N, with g the golden ratio (the bound for
    sequences whose partial quotients are all 1).
    """
    slots = int(blocks / share) + 1
    while share * slots - 3 - 3.53 * np.log(slots) < blocks:
        slots = max(slots + 1, int((blocks + 4 + 3.53 * np.log(slots)) / share))
    return slots


def schedule(spark, take: dict[str, int], block: int) -> DataFrame:  # noqa: ANN001
    """(source, k, slot): the slot of the k-th block of each source; distributed over ranges of slots."""
    names = sorted(take)
    total = sum(take.values())
    blocks = {s: -(-take[s] // block) for s in names}
    slots = max((slots_for(blocks[s], take[s] / total) for s in names if take[s]), default=0)
    edges = np.cumsum([take[s] / max(total, 1) for s in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy().astype(np.int64)
            point = ((slot.astype(np.uint64) + np.uint64(1)) * _GOLDEN >> np.uint64(11)).astype(np.float64) / 2.0**53
            which = np.minimum(np.searchsorted(edges, point, "right"), len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(which, pa.int32())], ["slot", "which"])

    rows = spark.range(slots).mapInArrow(run, "slot bigint, which int").withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    counts = rows.groupBy("which", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("which").orderBy("chunk")
    counts = counts.select("which", "chunk", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    ranked = rows.join(counts, ["which", "chunk"]).withColumn("k", F.col("offset") + F.row_number().over(Window.partitionBy("which", "chunk").orderBy("slot")) - 1)
    return ranked.select("which", F.col("k").cast("bigint").alias("k"), "slot")


def streams(sized: DataFrame, shard: int = 4096, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens) plus ``start``: tokens before the document in its source's shuffled stream.

    The prefix sum has two levels, buckets of about ``shard`` documents and their totals, so a source with a third of
    all rows is never in one task.
    """
    buckets = max(1, sized.count() // shard)
    keyed = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 8), F.lit(buckets)).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket")
    totals = totals.select("source", "bucket", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum("tokens").over(inside)).join(totals, ["source", "bucket"])
    return placed.select("doc_id", "source", "tokens", (F.col("offset") + F.col("upto") - F.col("tokens")).alias("start"))


def sized_documents(documents: DataFrame, weights: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """(doc_id, source, tokens) of the documents of listed sources that have tokens."""
    listed = documents.select(F.col(ident).cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    listed = listed.join(F.broadcast(weights.select("source").where("source is not null").distinct()), "source", "left_semi").where("doc_id is not null and length(text) > 0")
    return written(with_counts(listed.select("doc_id", "source", "text"), "text", folder=folder, file=file).where("tokens > 0"), "sized")


def mixture(sized: DataFrame, weights: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(slot, place, doc_id, source, copy, tokens): the mixture in order of (slot, place).

    No document is used more than its source's max_repeats times. ``weights`` is a configuration table (at most 100,000 rows, checked); a
    source listed twice counts with its first share and cap. Documents of null or unlisted sources take no part.
    """
    listed = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("more than 100,000 weighted sources")
    wanted = {r["source"]: (r["share"] or 0.0, r["cap"] or 0) for r in listed}
    stock = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row per listed source
    take = {s: n for s, n in plan(stock, wanted, total).items() if n > 0}
    spark = sized.sparkSession
    names = sorted(take)
    known = spark.createDataFrame([(s, i, take[s], stock[s]) for i, s in enumerate(names)], "source string, which int, take bigint, stock bigint")
    placed = streams(sized, seed=seed).join(F.broadcast(known), "source").where("start + tokens div 2 < take")
    # A copy is used if its middle lies before the target: the last document of a source misses it by half at most.
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(take - 1 - start - tokens div 2) div stock"))))
    copies = copies.withColumn("begin", F.col("start") + F.col("copy") * F.col("stock")).withColumn("k", F.expr(f"begin div {block}"))
    slots = schedule(spark, take, block)
    joined = copies.join(slots, ["which", "k"], "left")
    slot = F.coalesce("slot", F.raise_error(F.lit("a block without a slot")).cast("bigint"))
    return joined.select(slot.alias("slot"), (F.col("begin") % block).alias("place"), "doc_id", "source", F.col("copy").cast("int").alias("copy"), "tokens")


def report(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Shares actually reached, one row per listed source: (source, target_share, actual_share, tokens, uses, most_uses, max_repeats)."""
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("u"))
    sums = uses.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("u").alias("uses"), F.max("u").alias("most_uses"))
    zero = F.lit(0).cast("bigint")
    joined = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(sums, "source", "left")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / whole, F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("uses", zero).alias("uses"), F.coalesce("most_uses", zero).alias("most_uses"), "max_repeats")
