"""Joins by keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key in one part; keys with more are split.
PART_ROWS = 200_000
#: Keys that are broadcast at most. There are no more of them than rows / PART_ROWS; beyond this bound they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def split_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str], part_rows: int = PART_ROWS, how: str = "inner") -> DataFrame:
    """Inner or left join whose hot keys are split into parts of about part_rows rows of `big`, told apart by a hash of the
    columns `spread`; the rows of `small` are repeated for each part of their key. Keys that aren't hot join as they are.
    Rows with a null key join with none. `big` is read twice, so it should be a table or a written step."""
    heavy = big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows)
    heavy = heavy.select(*on, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    if not heavy.take(1):
        return big.join(small, on, how)
    if heavy.count() <= BROADCAST_KEYS:
        heavy = F.broadcast(heavy)
    one = F.coalesce("_parts", F.lit(1))
    left = big.join(heavy, on, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), one).cast("int")).drop("_parts")
    right = small.join(heavy, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")
