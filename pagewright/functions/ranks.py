"""Exact values at given ranks of large groups, without sorting them whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values that bracket the ranks, and the accuracy they are found with: a sketch's rank is off by less than a step.
STEPS, ACCURACY = 1000, 10_000
#: Groups that are broadcast at most (some kilobytes each); beyond it their join is shuffled.
BROADCAST_GROUPS = 20_000


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, n and a column for each rank: the value at that 0-based rank of the group's sorted values, the rank being an
    expression of the group's size. A sketch brackets each rank; rows below the bracket are only counted, and those within it,
    equal values as one, are sorted. Null values don't count; groups without values are left out."""
    d = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    steps = F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
    size = d.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), steps.alias("q"))
    at = lambda i, edge: F.when((i >= 0) & (i <= STEPS), F.get("q", i)).otherwise(F.col(edge))

    def wanted(name: str, rank: Column) -> Column:
        i = F.floor(rank * STEPS / F.col("n")).cast("int")
        return F.struct(F.lit(name).alias("name"), rank.alias("rank"), at(i - 1, "lo").alias("a"), at(i + 2, "hi").alias("b"))

    size = size.select(by, "n", F.array(*[wanted(k, f(F.col("n")).cast("long")) for k, f in ranks.items()]).alias("wanted"))
    few = size.count() <= BROADCAST_GROUPS
    d = d.join(F.broadcast(size) if few else size, by)
    near = d.select(by, "v", F.explode("wanted").alias("w")).where("v <= w.b")
    counts = near.groupBy(by, "w.name", F.when(F.col("v") >= F.col("w.a"), F.col("v")).alias("v")).agg(F.count("*").alias("here"), F.first("w.rank").alias("rank"))
    w = Window.partitionBy(by, "name").orderBy(F.asc_nulls_first("v"))  # null: all below the bracket
    hit = counts.withColumn("upto", F.sum("here").over(w)).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("here") <= F.col("rank")))
    found = hit.groupBy(by).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])
    return size.select(by, "n").join(found, by)
