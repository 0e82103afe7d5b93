"""Running counts and maxima, and what comes next, along a key that may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _running(df: DataFrame, key: str, block: Column, order: list[str], value: Column, name: str, how: Callable, both: Callable) -> DataFrame:
    """Rows are taken within blocks (a whole number that follows the order), and blocks get what those before them came
    to: no window holds more than a block, or a row for each block of a key."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    sums = df.groupBy(key, "_block").agg(how("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", how("_sum").over(before)).drop("_sum")
    out = df.withColumn("_here", how("_value").over(inside)).join(sums, [key, "_block"])
    return out.withColumn(name, both(F.col("_here"), F.col("_before"))).drop("_block", "_value", "_here", "_before")


def running_count(df: DataFrame, key: str, block: Column, order: list[str], flag: Column, name: str) -> DataFrame:
    """Adds the number of flagged rows of the key up to each row."""
    return _running(df, key, block, order, F.coalesce(flag.cast("long"), F.lit(0)), name, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def running_max(df: DataFrame, key: str, block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the greatest value of the key up to each row; null while there is none."""
    return _running(df, key, block, order, value, name, F.max, F.greatest)


def following(df: DataFrame, key: str, block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the key's next row; null for the last. Blocks as above: the last row of a block is followed by the
    first of the next block that has rows."""
    df = df.withColumn("_block", block)
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    first = df.groupBy(key, "_block").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    after = first.select(key, "_block", F.lead("_first").over(Window.partitionBy(key).orderBy("_block")).alias("_after"))
    out = df.withColumn("_row", F.lead(F.struct(value)).over(inside)).join(after, [key, "_block"])
    return out.withColumn(name, F.when(F.col("_row").isNull(), F.col("_after")).otherwise(F.col(f"_row.{value}"))).drop("_block", "_row", "_after")
