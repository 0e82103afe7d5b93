"""Queries of images, jobs, listings and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.strings import suffix
from pagewright.functions.tables import table
from pagewright.operators import imaging, registry, reports
from pagewright.sources.files import cases, properties, refused
from pagewright.streaming.ingest import counters, job, latest_states

_JOB = "CASE event_id % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED' ELSE 'RUNNING' END"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 8 by 8 pixels, in whole grey values."""
    px = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255 + 0.5).cast("double") % 256)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), px.alias("pixels"))


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = imaging.measured(_images(spark, sf_dir))
    return m.select("image_id", *[F.round(F.col(c) + 1e-9, 3).alias(c) for c in ("mean", "std", "blur", "noise")])


def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = imaging.measured(_images(spark, sf_dir)).withColumns(imaging.flags(F.lit(8), F.lit(8), F.lit(72)))
    return m.select("image_id", F.array_join(imaging.planned_steps(F.lit("RGB")), ",").alias("steps"))


def image_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _images(spark, sf_dir).withColumn("steps", F.array(F.lit("denoise"), F.lit("contrast"), F.lit("threshold")))
    return imaging.processed(i).select("image_id", "width", "height", F.array_join("applied", ",").alias("applied"), F.size("pixels").alias("n_pixels"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.expr(_JOB).alias("status"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_states(_jobs(spark, sf_dir)).select("job_id", "status")


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(latest_states(_jobs(spark, sf_dir)))


def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty files that came last, each once (a list of recent files is that long)."""
    f = table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max("received_at").alias("t"), F.max("doc_name").alias("doc_name"))
    return f.orderBy(F.desc("t"), "doc_id").limit(20).select("doc_id", "doc_name")


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred jobs that began last (a list of jobs is that long)."""
    return latest_states(_jobs(spark, sf_dir)).orderBy(F.desc("created"), "job_id").limit(100).select("job_id", "status")


def one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job(latest_states(_jobs(spark, sf_dir)), 7).select("job_id", "status", "created")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max("doc_name").alias("name"), F.max("received_at").alias("modified"))
    return f.select("doc_id", F.col("doc_id").cast("string").alias("path"), "name", (F.col("doc_id") % 10 == 0).alias("is_dir"), "modified")


def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose name has a word, with their place in a listing by name."""
    return reports.listing(_named(spark, sf_dir), "survey", [".pdf"]).select("doc_id", "name", "place")


def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, the latest first after the folders."""
    return reports.listing(_named(spark, sf_dir), by="time").select("doc_id", "place")


def command_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which name, title or author has a word, as a palette of commands is searched."""
    f = table(spark, sf_dir, "files").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("doc_name", "title", "author")])
    return reports.matching(f, ["doc_name", "title", "author"], "Index").select("doc_id")


def page_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each file dealt to three workers in turn."""
    return table(spark, sf_dir, "raw_pages").select("doc_id", "page_index").distinct().withColumn("worker", registry.round_robin(F.col("page_index"), 3))


def file_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with known extensions and, for every third, a ground truth beside it."""
    f = table(spark, sf_dir, "files").select("doc_id", F.concat(F.lit("in/"), F.lower("doc_name")).alias("path")).distinct()
    truth = f.where("doc_id % 3 = 0").select(F.regexp_replace("path", r"\.[a-z]+$", ".json").alias("path"))
    return cases(f.select("path").unionByName(truth))


def refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no source reads as they are: those of a format that needs a decoder, and unknown ones."""
    f = table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max("mime_type").alias("mime"), F.max("doc_name").alias("name"))
    return refused(f.select("doc_id", F.lit(None).cast("string").alias("format"), F.when(F.col("doc_id") % 9 != 0, suffix(F.col("name"))).alias("extension"), F.when(F.col("doc_id") % 9 != 0, F.col("mime")).alias("mime")))


def file_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of files as a decoder gives them, taken apart."""
    f = table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max("title").alias("t"), F.max("author").alias("a"), F.max("lang").alias("l"))
    raw = F.map_from_arrays(F.array(F.lit("Title"), F.lit("Author"), F.lit("Lang")), F.array("t", "a", "l"))
    return f.select("doc_id", *properties(raw)).select("doc_id", "title", "author", F.col("extra")["Lang"].alias("lang"), F.size("extra").alias("n_extra"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that were delivered more than once, and blocks whose page isn't known: what a document must not have."""
    b = table(spark, sf_dir, "blocks")
    twice = b.groupBy(F.col("block_uid").alias("id")).count().where("count > 1").select("id", F.lit("delivered again").alias("violation"))
    lost = b.select(F.col("block_uid").alias("id"), "doc_id", "page_index").distinct().join(table(spark, sf_dir, "raw_pages").select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti").select("id", F.lit("no such page").alias("violation"))
    return twice.unionByName(lost)


def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a task, one of which has changed its state."""
    m = registry.with_state(registry.models(spark), "easyocr", "disabled")
    return registry.of_task(m, "ocr").select("model_id", "architecture", "size_bytes", registry.store_name(F.concat("task", F.lit("/"), "model_id")).alias("folder"), "state")


def queries() -> dict:
    return {
        "image_stats": image_stats, "image_plan": image_plan, "image_steps": image_steps, "job_states": job_states, "job_counts": job_counts, "job_list": job_list, "one_job": one_job, "file_times": file_times, "command_search": command_search, "page_workers": page_workers, "recent_files": recent_files, "file_search": file_search, "file_cases": file_cases,
        "refused_files": refused_files, "file_properties": file_properties, "duplicate_ids": duplicate_ids, "model_list": model_list,
    }


def oracle_sql() -> dict[str, str]:
    px = "px AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 255 + 0.5::DOUBLE))::BIGINT % 256) AS p FROM embeddings), g AS (SELECT image_id, i // 8 AS y, i % 8 AS x, p[i + 1]::DOUBLE AS v, p FROM px, range(64) r(i))"
    at = lambda dy, dx: f"p[((y + {dy}) * 8 + x + {dx} + 1)::INT]"
    jobs = f"j AS (SELECT user_id AS job_id, ts AS tm, event_id AS seq, {_JOB} AS status FROM events), s AS (SELECT job_id, coalesce(arg_min(status, row(tm, seq)) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELLED')), CASE WHEN bool_or(status = 'RUNNING') THEN 'RUNNING' ELSE 'QUEUED' END) AS status, min(tm) AS created FROM j GROUP BY 1)"
    named = "f AS (SELECT doc_id, max(doc_name) AS name, max(received_at) AS modified, doc_id % 10 = 0 AS is_dir FROM files GROUP BY doc_id)"
    specs = ", ".join(f"('{m[0]}', '{m[3]}', {m[6]}, '{m[4]}')" for m in registry.MODELS)
    return {
        "image_stats": f"WITH {px}, m AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS std FROM g GROUP BY 1), l AS (SELECT image_id, var_pop({at(-1, 0)} + {at(1, 0)} + {at(0, -1)} + {at(0, 1)} - 4 * v) AS blur FROM g WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1), dx AS (SELECT image_id, var_pop(abs({at(0, 1)} - v)) AS a FROM g WHERE x < 7 GROUP BY 1), dy AS (SELECT image_id, var_pop(abs({at(1, 0)} - v)) AS b FROM g WHERE y < 7 GROUP BY 1) SELECT image_id, round(mean + 1e-9::DOUBLE, 3) AS mean, round(std + 1e-9::DOUBLE, 3) AS std, round(blur + 1e-9::DOUBLE, 3) AS blur, round((a + b) / 2 + 1e-9::DOUBLE, 3) AS noise FROM m JOIN l USING (image_id) JOIN dx USING (image_id) JOIN dy USING (image_id)",
        "image_steps": "SELECT vec_id AS image_id, 8 AS width, 8 AS height, 'denoise,contrast,threshold' AS applied, 64 AS n_pixels FROM embeddings",
        "job_states": f"WITH {jobs} SELECT job_id, status FROM s",
        "job_list": f"WITH {jobs} SELECT job_id, status FROM s ORDER BY created DESC, job_id LIMIT 100",
        "one_job": f"WITH {jobs} SELECT job_id, status, created FROM s WHERE job_id = 7",
        "file_times": f"WITH {named} SELECT doc_id, row_number() OVER (ORDER BY is_dir DESC, modified DESC, doc_id::VARCHAR) AS place FROM f WHERE NOT starts_with(name, '.')",
        "command_search": "SELECT doc_id FROM (SELECT doc_id, max(doc_name) AS n, max(title) AS t, max(author) AS a FROM files GROUP BY 1) WHERE contains(lower(coalesce(n, '') || '|' || coalesce(t, '') || '|' || coalesce(a, '')), 'index')",
        "page_workers": "SELECT DISTINCT doc_id, page_index, page_index % 3 AS worker FROM raw_pages",
        "job_counts": f"WITH {jobs} SELECT status, count(*) AS jobs FROM s GROUP BY 1",
        "recent_files": "SELECT doc_id, max(doc_name) AS doc_name FROM files GROUP BY 1 ORDER BY max(received_at) DESC, doc_id LIMIT 20",
        "file_search": f"WITH {named} SELECT doc_id, name, row_number() OVER (ORDER BY is_dir DESC, lower(name), doc_id::VARCHAR) AS place FROM f WHERE contains(lower(name), 'survey') AND NOT starts_with(name, '.') AND (is_dir OR ends_with(lower(name), '.pdf'))",
        "file_cases": r"WITH f AS (SELECT DISTINCT doc_id, 'in/' || lower(doc_name) AS path FROM files), t AS (SELECT regexp_replace(path, '\.[a-z]+$', '') AS stem, regexp_replace(path, '\.[a-z]+$', '.json') AS truth_path FROM f WHERE doc_id % 3 = 0) SELECT regexp_extract(path, '([^/]*)\.[a-z]+$', 1) AS case_id, path, truth_path FROM f LEFT JOIN t ON regexp_replace(path, '\.[a-z]+$', '') = t.stem WHERE regexp_matches(path, '\.(pdf|docx|pptx|png|jpg|jpeg|webp|tif|tiff|html|md|txt)$')",
        "refused_files": r"SELECT doc_id, CASE WHEN lower(name) LIKE '%.pdf' OR mime = 'application/pdf' THEN 'source of pdf is a placeholder and needs a decoder' ELSE 'unsupported format' END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN max(mime_type) END AS mime, CASE WHEN doc_id % 9 <> 0 THEN max(doc_name) ELSE '' END AS name FROM files GROUP BY doc_id) WHERE NOT regexp_matches(lower(name), '\.(tif|tiff|png|jpg|jpeg|webp)$') AND coalesce(mime, '') NOT LIKE 'image/%'",
        "file_properties": "SELECT doc_id, nullif(max(title), '') AS title, nullif(max(author), '') AS author, max(lang) AS lang, 1 AS n_extra FROM files GROUP BY 1",
        "duplicate_ids": "SELECT block_uid AS id, 'delivered again' AS violation FROM blocks GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT block_uid, 'no such page' FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM raw_pages p WHERE p.doc_id = b.doc_id AND p.page_index = b.page_index)",
        "model_list": f"SELECT model_id, architecture, size_bytes, 'ocr_' || model_id AS folder, CASE model_id WHEN 'easyocr' THEN 'disabled' ELSE 'ready' END AS state FROM (VALUES {specs}) v(model_id, architecture, size_bytes, task) WHERE task = 'ocr'",
    }
