"""Documents and jobs as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.strings import stem
from pagewright.sources.detect import detect

# States of a job, and those that end it.
STATES = ("QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED")
FINAL = ("COMPLETED", "FAILED", "CANCELLED")


def documents(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as they come, a bounded number at a time: doc_id, content, format, status."""
    schema = spark.read.format("binaryFile").load(path).schema
    s = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    found = detect(F.col("content"), F.col("path"))
    return s.select(stem(F.col("path")).alias("doc_id"), "content", "modificationTime", found.alias("d")).select("doc_id", "content", "modificationTime", "d.format", F.coalesce("d.error", F.lit("ok")).alias("status"))


def windowed(events: DataFrame, time: str, by: list[str], length: str, late: str) -> DataFrame:
    """Counts of events in windows of their own time; events later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def latest_states(events: DataFrame) -> DataFrame:
    """job_id, at, seq, status -> the job's state. The first event that ends it counts; before it a job that runs isn't queued
    again, so it is RUNNING if it ever was. The same rule as that of the stream (jobs.step)."""
    final = F.col("status").isin(*FINAL)
    g = events.where(F.col("status").isin(*STATES)).groupBy("job_id").agg(F.min(F.when(final, F.struct("at", "seq", "status"))).alias("end"), F.bool_or(F.col("status") == "RUNNING").alias("ran"), F.min("at").alias("created"))
    return g.select("job_id", F.coalesce("end.status", F.when(F.col("ran"), "RUNNING").otherwise("QUEUED")).alias("status"), "created", F.col("end.at").alias("ended"))


def job(states: DataFrame, job_id) -> DataFrame:
    return states.where(F.col("job_id") == job_id)


def without_job(states: DataFrame, job_id) -> DataFrame:
    return states.where(F.col("job_id") != job_id)


def in_order(results: DataFrame, place: str) -> Iterator[Row]:
    """Results one by one in the order of their inputs; a driver that wants them as they come reads results.toLocalIterator()."""
    return results.orderBy(place).toLocalIterator()


def counters(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("jobs"))
