"""Reading the tables of a data folder, and the parts several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks and chunks in one form: tbl, row_uid, doc_id, page_index, text."""
    b = table(spark, sf_dir, "blocks").select(F.lit("blocks").alias("tbl"), F.col("block_uid").alias("row_uid"), "doc_id", "page_index", "text")
    c = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_uid").alias("row_uid"), "doc_id", "page_index", "text")
    return b.unionByName(c)


#: Repeated keys that are broadcast at most (16 bytes each).
BROADCAST_KEYS = 1_000_000


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys, whose repeated rows are equal. Where few keys repeat, only their rows are
    shuffled: the other rows, with their long texts, stay where they are. Null keys count as values."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    n = many.count()
    if n == 0:
        return df
    if n > BROADCAST_KEYS:
        return df.dropDuplicates(list(keys))
    again, same = F.broadcast(many), F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates(list(keys)))
