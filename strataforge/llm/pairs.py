"""All pairs within groups, spread over tasks, for results that are defined as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that one task may hold on one side.
BLOCK = 512


def pairs_within(members: DataFrame, keys: list[str], ident: str, size: str, carry: list[str] | None = None) -> DataFrame:
    """Pairs of members with equal keys, the smaller ident first.

    ``size`` is a column with the group's number of members. A group is cut into
    blocks of about ``BLOCK`` members; each pair of blocks is one join key, so a hot group is spread over
    as many tasks as it has block pairs and no task holds a whole group. Groups of one block
    (nearly all) are not replicated. Only for results that TESTDATA defines as pairs.
    """
    carry = carry or []
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    base = members.select(*keys, ident, *carry, blocks.alias("_blocks")).withColumn("_block", F.pmod(F.xxhash64(F.col(ident)), F.col("_blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    left = base.select("*", others).where("_block <= _other").select(*keys, F.col("_block").alias("_x"), F.col("_other").alias("_y"), *[F.col(c).alias(f"{c}_l") for c in (ident, *carry)])
    right = base.select("*", others).where("_other <= _block").select(*keys, F.col("_other").alias("_x"), F.col("_block").alias("_y"), *[F.col(c).alias(f"{c}_r") for c in (ident, *carry)])
    joined = left.join(right, [*keys, "_x", "_y"])
    a, b = F.col(f"{ident}_l"), F.col(f"{ident}_r")
    # Within one block both orders meet; between two blocks each pair meets once, in either order.
    joined = joined.where((a < b) | ((a > b) & (F.col("_x") < F.col("_y"))))
    pick = [F.when(a < b, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r")).alias(f"{c}_a") for c in (ident, *carry)]
    pick += [F.when(a < b, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l")).alias(f"{c}_b") for c in (ident, *carry)]
    return joined.select(*keys, *pick)
