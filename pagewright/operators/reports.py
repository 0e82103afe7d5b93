"""Results written for people and files: documents by format, benchmark reports, ingest verdicts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.running import running_count

# Extensions of the formats of export; columns of a benchmark's table.
EXTENSIONS = {"markdown": ".md", "html": ".html", "json": ".json", "text": ".txt", "docx": ".docx", "epub": ".epub", "pdfa": ".html"}
COLUMNS = ("case_id", "adapter", "success", "pages", "mean_ms", "median_ms", "p95_ms", "p99_ms", "cold_start_ms", "docs_per_s", "pages_per_s", "peak_mb")


def write_documents(parts: DataFrame, path: str, extension: str = ".md", overwrite: bool = False) -> DataFrame:
    """doc_id, body (and part, if documents come in parts) -> files {doc_id}.md or {doc_id}-{part}.md below path, a folder all
    executors share; gives the file names and whether each was written. A file that is there stays unless overwritten. Files are written
    under another name first, so a task that is lost leaves none cut off."""
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.when(F.col("part") >= 0, F.col("part").cast("string"))) if "part" in parts.columns else F.col("doc_id").cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            done = []
            for file, body in zip(pdf.name, pdf.body, strict=True):
                at = f"{root}/{file}{extension}"
                there = fs.get_file_info(at).type != pafs.FileType.NotFound
                if overwrite or not there:
                    own = f"{at}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(own) as out:
                        out.write(body.encode())
                    fs.move(own, at)
                done.append(overwrite or not there)
            yield pd.DataFrame({"file": pdf.name + extension, "written": done})

    return parts.where("body is not null").select(name.alias("name"), "body").mapInPandas(run, "file string, written boolean")


def write_table(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results with the columns of a benchmark as CSV with a head; columns that are missing are empty."""
    cols = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    results.select(*cols).write.mode("overwrite" if overwrite else "ignore").option("header", True).csv(path)


def write_json(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results as JSON lines, nulls kept."""
    results.write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", "false").json(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """A row of a Markdown table for each row of a DataFrame."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def markdown_report(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """line, text: a Markdown table, its head first; lines are in the given order."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join("---" for _ in columns) + " |")], "part int, text string")
    body = df.select(F.lit(2).alias("part"), markdown_rows(df, columns).alias("text"), *order)
    for c in order:
        head = head.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return head.unionByName(body).orderBy("part", *order).select("text")


def process_results(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a document: status (completed with blocks, else failed with the reason) and counts; a document that fails never
    stops the others."""
    n = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), (F.max("page_index") + 1).alias("pages"))
    d = documents.join(n, "doc_id", "left")
    ok = (F.coalesce("status", F.lit("ok")) == "ok") & F.col("blocks").isNotNull()
    return d.select("doc_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, F.when(F.coalesce("status", F.lit("ok")) != "ok", F.col("status")).otherwise("no content")).alias("error"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("pages", F.lit(0)).alias("pages"))


def raise_on_failure(results: DataFrame) -> DataFrame:
    """The fail-fast policy: an error for the first failed document; continuing is to leave the rows as they are."""
    bad = results.where("status = 'failed'").select("doc_id", "error").take(1)
    if bad:
        raise RuntimeError(f"document {bad[0].doc_id}: {bad[0].error}")
    return results


def listing(files: DataFrame, text: str = "", extensions: list[str] | None = None, by: str = "name") -> DataFrame:
    """path, name, is_dir, modified -> those that are shown and their place: no dot-files, names that contain the text, folders or files
    with one of the extensions; folders first, then by name or the latest first. Places are counted within first letters (or days),
    so that no task holds the whole listing."""
    low = F.lower("name")
    shown = ~F.col("name").startswith(".") & low.contains(text.lower())
    if extensions:
        ends = F.lit(False)
        for e in extensions:
            ends = ends | low.endswith(e.lower())
        shown = shown & (F.col("is_dir") | ends)
    group = F.when(F.col("is_dir"), 0).otherwise(1)
    if by == "name":
        part, order = F.coalesce(F.ascii(low), F.lit(0)), ["_dir", "_low", "path"]
        f = files.where(shown).withColumn("_low", low)
    else:
        part, order = 1_000_000 - F.datediff(F.col("modified"), F.lit("1970-01-01")), ["_dir", "_late", "path"]
        f = files.where(shown).withColumn("_late", -F.unix_micros("modified"))
    f = f.withColumn("_dir", group).withColumn("_all", F.lit(0))
    out = running_count(f, "_all", group * 10_000_000 + part, order, F.lit(True), "place")
    return out.drop("_dir", "_all", "_low", "_late")


def matching(commands: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows of which any of the columns contains the text, whatever its case; all of them if it is empty."""
    hit = F.lit(text == "")
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return commands.where(hit)
