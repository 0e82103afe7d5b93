"""Queries over pages: inspection, classification and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.skew import split_join
from pagewright.functions.tables import table
from pagewright.operators import inspection as I
from pagewright.plans import laying_out as L


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, format: pdf by the file's type, or its name where the type is missing."""
    f = table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max("mime_type").alias("mime"), F.max(F.lower("doc_name")).alias("name"))
    pdf = (F.col("mime") == "application/pdf") | F.col("mime").isNull() & F.col("name").endswith(".pdf")
    return f.select("doc_id", F.when(pdf, "pdf").otherwise("other").alias("format"))


def _pages(spark: SparkSession, sf_dir: str, formats: bool = False) -> DataFrame:
    """Pages once each, with their file's format if it is wanted; coverage is the share that the boxes of figures take."""
    p = table(spark, sf_dir, "raw_pages").select("doc_id", "page_index", F.coalesce("char_count", F.lit(0)).alias("chars"), F.coalesce("image_count", F.lit(0)).alias("images")).distinct()
    side = lambda a, b: F.round((F.col(b) - F.col(a)) * 1000).cast("long")
    if formats:  # before anything else is joined, as a split join reads its rows twice
        p = split_join(p, _formats(spark, sf_dir), ["doc_id"], ["page_index"], how="left").fillna("other", ["format"])
    areas = L._boxes(spark, sf_dir, "figure").groupBy("doc_id", "page_index").agg(F.collect_list(side("left", "right") * side("top", "bottom") / 1e6).alias("areas"))
    p = p.join(areas, ["doc_id", "page_index"], "left").withColumn("coverage", F.round(I.image_coverage(F.coalesce("areas", F.array().cast("array<double>")), F.lit(1.0)), 6)).drop("areas")
    return p.withColumn("content_type", I.content_type(F.col("chars"), F.col("images"))).withColumn("density", I.text_density(F.col("chars")))


_PAGES = f"""{L._BOXES}, fig AS (SELECT doc_id, page_index, least(1.0::DOUBLE, round(sum(round((br - bl) * 1000)::BIGINT * round((bb - bt) * 1000)::BIGINT)::BIGINT / 1e6::DOUBLE, 6)) AS covered FROM boxes WHERE lower(block_type) = 'figure' GROUP BY 1, 2),
    p AS (SELECT q.*, CASE WHEN chars >= 50 AND images = 0 THEN 'DIGITAL_TEXT_ONLY' WHEN chars < 20 AND images > 0 THEN 'SCANNED_IMAGE_ONLY' WHEN chars >= 20 AND images > 0 THEN 'HYBRID' ELSE 'EMPTY' END AS content_type,
      least(1.0::DOUBLE, round(chars / 2500.0::DOUBLE, 4)) AS density, coalesce(covered, 0.0::DOUBLE) AS coverage
    FROM (SELECT DISTINCT doc_id, page_index, coalesce(char_count, 0) AS chars, coalesce(image_count, 0) AS images FROM raw_pages) q LEFT JOIN fig USING (doc_id, page_index))"""


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their file's format and what their blocks tell: tables, figures, formulas."""
    kind = F.lower("block_type")
    b = table(spark, sf_dir, "blocks").groupBy("doc_id", "page_index").agg(*[F.bool_or(kind == k).alias(f"has_{k}s") for k in ("table", "figure", "formula")])
    p = _pages(spark, sf_dir, formats=True).join(b, ["doc_id", "page_index"], "left").fillna(False, ["has_tables", "has_figures", "has_formulas"])
    return I.characteristics(p).withColumn("complexity", I.complexity())


_FULL = f"""{_PAGES}, b AS (SELECT doc_id, page_index, bool_or(lower(block_type) = 'table') AS t, bool_or(lower(block_type) = 'figure') AS f, bool_or(lower(block_type) = 'formula') AS m FROM blocks GROUP BY 1, 2),
    fo AS (SELECT doc_id, coalesce(max(mime_type) = 'application/pdf', ends_with(max(lower(doc_name)), '.pdf')) AS pdf FROM files GROUP BY 1),
    c AS (SELECT p.*, coalesce(t, false) AS has_tables, coalesce(f, false) AS has_figures, coalesce(m, false) AS has_formulas, coalesce(pdf, false) AS pdf, CASE WHEN pdf THEN density ELSE 1.0::DOUBLE END AS ratio,
      CASE WHEN pdf IS NOT TRUE THEN 0.0::DOUBLE WHEN content_type = 'SCANNED_IMAGE_ONLY' THEN 1.0::DOUBLE WHEN density > 0.8 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS scan_prob, CASE WHEN pdf AND images > 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS image_density FROM p LEFT JOIN b USING (doc_id, page_index) LEFT JOIN fo USING (doc_id)),
    x AS (SELECT *, least(1.0::DOUBLE, 0.4::DOUBLE * (1.0::DOUBLE - ratio) + 0.3::DOUBLE * scan_prob + 0.2::DOUBLE * image_density + 0.1::DOUBLE * has_tables::INT + 0.1::DOUBLE * has_figures::INT + 0.15::DOUBLE * has_formulas::INT) AS complexity FROM c)"""
_MEAN = "floor((2 * sum(round({0} * {1})::BIGINT)::BIGINT + count(*)) / (2 * count(*))) / {1}::DOUBLE"
_CATEGORY = f"""g AS (SELECT doc_id, count(*) AS n, count_if(content_type = 'SCANNED_IMAGE_ONLY') AS scanned, count_if(content_type IN ('SCANNED_IMAGE_ONLY', 'EMPTY')) AS no_text, count_if(content_type = 'DIGITAL_TEXT_ONLY') AS digital, count_if(content_type IN ('DIGITAL_TEXT_ONLY', 'HYBRID')) AS with_text, {_MEAN.format('coverage', '1e6')} AS coverage, sum(chars) AS chars, {_MEAN.format('density', '1e4')} AS avg_density FROM p GROUP BY 1),
    k AS (SELECT *, CASE WHEN scanned = n AND coverage >= 0.70 THEN 'IMAGE_ONLY' WHEN no_text / n >= 0.75 THEN 'SCANNED' WHEN digital = n OR (with_text = n AND coverage < 0.35) THEN 'DIGITALLY_GENERATED' ELSE 'HYBRID' END AS category FROM g)"""
_ROUTED = f"""{_FULL}, {_CATEGORY}, r AS (SELECT doc_id, bool_or(has_formulas) AS fo, bool_or(has_tables) AS ta, bool_or(has_figures) AS fi, floor((2 * sum(round(complexity * 1e6::DOUBLE)::BIGINT)::BIGINT + count(*)) / (2 * count(*))) / 1e6::DOUBLE AS a, floor((2 * sum(round(complexity * 1e6::DOUBLE)::BIGINT)::BIGINT + count(*) * 10000) / (2 * count(*) * 10000)) / 100.0::DOUBLE AS avg_complexity FROM x GROUP BY 1),
    s0 AS (SELECT r.*, CASE WHEN category = 'SCANNED' THEN 'scanned_document' WHEN fo THEN 'technical_report' WHEN ta AND a > 0.5 THEN 'form_invoice' WHEN fi AND a > 0.4 THEN 'complex_multi_column' ELSE 'digital_pdf' END AS kind FROM r JOIN k USING (doc_id)),
    s AS (SELECT *, CASE WHEN kind IN ('scanned_document', 'complex_multi_column', 'technical_report') THEN 'deep_ml' WHEN a >= 0.7 THEN 'vlm_fallback' ELSE 'fast_path' END AS path FROM s0)"""


def page_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)


def doc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.document_category(_pages(spark, sf_dir))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _full(spark, sf_dir)
    return c.select("doc_id", "page_index", F.round("complexity", 6).alias("complexity"), I.page_path(F.col("complexity")).alias("path"))


def doc_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.document_routing(_full(spark, sf_dir), I.document_category(_pages(spark, sf_dir)))


def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: what was decided for it, why, and by which provider it is processed."""
    return I.decisions(_full(spark, sf_dir), doc_routing(spark, sf_dir))


def doc_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.telemetry(doc_routing(spark, sf_dir))


def page_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of first pages only."""
    return decision_trace(spark, sf_dir).where("page_index = 0").select("doc_id", "decision")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).withColumn("steps", I.capabilities())


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("steps")
    return _plans(spark, sf_dir).select("doc_id", "page_index", F.array_join(s, ",").alias("steps"), F.array_join(I.planned(s, 0), ",").alias("providers"), F.array_join(I.planned(s, 1), ",").alias("models"), I.planned_ms(s).alias("planned_ms"))


def plan_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.execution(_plans(spark, sf_dir))


def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(_full(spark, sf_dir))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the confidence of their blocks; how often a page was delivered is taken as how often it was tried."""
    tries = table(spark, sf_dir, "raw_pages").groupBy("doc_id", "page_index").agg((F.count("*") - 1).alias("retry_count"))
    b = table(spark, sf_dir, "blocks").select("block_uid", "doc_id", "page_index", F.col("provenance.confidence").alias("confidence")).distinct()
    return I.quality_gate(b.join(tries, ["doc_id", "page_index"], "left"))


def page_class_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the inspector's guesses and the rule agree: counts of pages for each combination, with subtotals."""
    p = table(spark, sf_dir, "raw_pages").select("doc_id", "page_index", "page_class", I.content_type(F.coalesce("char_count", F.lit(0)), F.coalesce("image_count", F.lit(0))).alias("ruled")).distinct()
    return p.select(F.coalesce("page_class", F.lit("NONE")).alias("guessed"), "ruled").rollup("guessed", "ruled").agg(F.count("*").alias("pages"))


# Providers known by default: id, capability, whether it is remote; a remote one without an endpoint isn't available.
PROVIDERS = [
    ("ocr.rapidocr", "ocr", False),
    ("ocr.tesseract", "ocr", False),
    ("ocr.surya", "ocr", False),
    ("ocr.remote", "ocr", True),
    ("layout.rtdetr", "layout", False),
    ("layout.yolo", "layout", False),
    ("table.slanet", "table", False),
    ("figure.local", "figure", False),
    ("formula.local", "formula", False),
    ("vlm.local", "vlm", False),
    ("vlm.huggingface", "vlm", False),
    ("vlm.remote", "vlm", True),
    ("vlm.openai", "vlm", True),
]


def _providers(spark: SparkSession) -> DataFrame:
    """Those by default, of which one local engine is down."""
    rows = [(p, c, r, not r and p != "ocr.rapidocr") for p, c, r in PROVIDERS]
    return spark.createDataFrame(rows, "provider_id string, capability string, remote boolean, available boolean")


_PROVIDERS_SQL = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {str(r).lower()}, {str(not r and p != 'ocr.rapidocr').lower()})" for p, c, r in PROVIDERS) + ") v(provider_id, capability, remote, available))"


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt for a request of each file: capabilities, policies and overrides in turn."""
    k, d = F.col("doc_id") % 7, F.col("doc_id")
    pick = lambda by, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    f = table(spark, sf_dir, "files").select("doc_id").distinct()
    over = F.when(k == 1, "ocr.remote").when(k == 2, "ocr.rapidocr").when(k == 3, "nothing.here")
    r = f.select(d.alias("request_id"), pick(d, "ocr", "layout", "table", "vlm", "figure").alias("capability"), pick(F.floor(d / 5), "local_only", "local_preferred", "remote_only").alias("policy"), F.when(k == 4, "vlm.openai").alias("page_override"), over.alias("override"), F.when(k == 5, F.array(F.lit("ocr.tesseract"), F.lit("ocr.remote"))).alias("priority"))
    return I.choose_provider(r, _providers(spark))


_CHOICE = f"""WITH RECURSIVE {_PROVIDERS_SQL}, r AS (SELECT DISTINCT doc_id AS request_id, ['ocr', 'layout', 'table', 'vlm', 'figure'][(doc_id % 5 + 1)::INT] AS capability, ['local_only', 'local_preferred', 'remote_only'][((doc_id // 5) % 3 + 1)::INT] AS policy,
      CASE doc_id % 7 WHEN 4 THEN 'vlm.openai' WHEN 1 THEN 'ocr.remote' WHEN 2 THEN 'ocr.rapidocr' WHEN 3 THEN 'nothing.here' END AS o, doc_id % 7 = 5 AS own FROM files),
    t AS (SELECT request_id, policy, o IS NOT NULL AS has, list_concat(CASE WHEN o IS NULL THEN [] ELSE [o] END, CASE WHEN own THEN ['ocr.tesseract', 'ocr.remote'] WHEN capability = 'ocr' THEN ['ocr.rapidocr', 'ocr.surya', 'ocr.tesseract', 'ocr.remote'] WHEN capability = 'layout' THEN ['layout.rtdetr', 'layout.yolo'] WHEN capability = 'table' THEN ['table.slanet'] WHEN capability = 'vlm' THEN ['vlm.local', 'vlm.huggingface', 'vlm.remote'] ELSE [capability || '.local'] END) AS l FROM r),
    u AS (SELECT request_id, policy, has, unnest(l) AS provider_id, unnest(range(1, len(l) + 1)) AS attempt FROM t),
    v AS (SELECT u.*, remote, available, has AND attempt = 1 AS first FROM u LEFT JOIN pr USING (provider_id)),
    w AS (SELECT *, CASE WHEN remote IS NULL THEN 'not registered' WHEN policy = 'local_only' AND remote OR NOT first AND policy = 'remote_only' AND NOT remote THEN 'policy' WHEN first THEN 'override' WHEN available THEN 'chain' ELSE 'health' END AS why FROM v),
    z AS (SELECT *, CASE why WHEN 'policy' THEN 'SKIPPED' WHEN 'override' THEN 'SELECTED' WHEN 'chain' THEN 'SELECTED' ELSE 'FAILED' END AS result FROM w)
    SELECT request_id, attempt::INT AS attempt, provider_id, result, why FROM z WHERE attempt <= coalesce((SELECT min(y.attempt) FROM z y WHERE y.request_id = z.request_id AND y.result = 'SELECTED'), 1000)"""


def provider_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each privacy policy leaves of the providers of each capability."""
    parts = [I.listed_providers(_providers(spark), c, p).select(F.lit(p).alias("policy"), "capability", "provider_id") for c in ("ocr", "vlm") for p in ("local_only", "remote_only", "remote_allowed")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def ocr_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine each file gets: the one it asks for, or the first of the chain that is available."""
    ready = spark.createDataFrame([("rapidocr", False), ("tesseract", True), ("remote_http", True), ("easyocr", True)], "provider_id string, available boolean")
    k = F.col("doc_id") % 4
    r = table(spark, sf_dir, "files").select("doc_id").distinct().select(F.col("doc_id").alias("request_id"), F.when(k == 0, "RapidOCR").when(k == 1, "easyocr").when(k == 2, "auto").otherwise("remote_http").alias("requested"))
    return I.choose_ocr(r, ready)


def queries() -> dict:
    return {
        "page_inspect": page_inspect, "doc_category": doc_category, "page_paths": page_paths, "doc_routing": doc_routing, "decision_trace": decision_trace, "page_decision": page_decision, "doc_telemetry": doc_telemetry, "page_plan": page_plan, "plan_execution": plan_execution,
        "inspect_summary": inspect_summary, "quality_gate": quality_gate, "page_class_check": page_class_check, "provider_choice": provider_choice, "provider_list": provider_list, "ocr_choice": ocr_choice,
    }


def oracle_sql() -> dict[str, str]:
    path = "CASE WHEN ratio >= 0.85 AND scan_prob < 0.15 AND NOT has_tables AND NOT has_formulas THEN 'fast_path' WHEN (scan_prob >= 0.80 OR complexity >= 0.75) AND image_density >= 0.7 THEN 'vlm_fallback' ELSE 'deep_ml' END"
    layout = "(scan_prob >= 0.5 OR image_density > 0.3 OR has_tables)"
    steps = f"""y AS (SELECT *, list_filter([CASE WHEN pdf AND ratio >= 0.8 AND scan_prob < 0.2 THEN 'native_pdf' ELSE 'ocr' END, CASE WHEN {layout} THEN 'layout' END, CASE WHEN has_tables THEN 'table' END, CASE WHEN has_figures THEN 'figure' END, CASE WHEN has_formulas THEN 'formula' END], lambda v: v IS NOT NULL) AS l FROM x)"""
    named = lambda x, which: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in I.STEPS.items()) + " END"
    traced = f"SELECT doc_id, page_index, CASE WHEN path = 'fast_path' THEN '{I.FAST_DECISION}' ELSE '{I.DEEP_DECISION}' END AS decision, CASE WHEN path = 'fast_path' THEN '{I.FAST_REASON}' ELSE 'Scanned/complex page (complexity: ' || round(complexity, 2)::VARCHAR || '). Escalated to rtdetr_layout and default OCR.' END AS reason, CASE WHEN path = 'fast_path' THEN 'native_pdf_backend' ELSE 'rtdetr_layout' END AS provider_id, 'LOCAL' AS mode FROM x JOIN s USING (doc_id)"
    allowed = "(policy = 'remote_allowed' OR (policy = 'local_only') <> remote)"
    return {
        "page_inspect": f"WITH {_PAGES} SELECT doc_id, page_index, chars, images, coverage, content_type, density FROM p",
        "doc_category": f"WITH {_PAGES}, {_CATEGORY} SELECT doc_id, category, n::INT AS n_pages, chars > 20 AS has_native_text, category = 'DIGITALLY_GENERATED' AS fast_path, category IN ('SCANNED', 'IMAGE_ONLY', 'HYBRID') AS ocr_suggested, category = 'IMAGE_ONLY' AS vlm_suggested, avg_density, round(no_text / n, 4) AS scanned_ratio FROM k",
        "page_paths": f"WITH {_FULL} SELECT doc_id, page_index, round(complexity, 6) AS complexity, {path} AS path FROM x",
        "doc_routing": f"WITH {_ROUTED} SELECT doc_id, kind, avg_complexity, path FROM s",
        "decision_trace": f"WITH {_ROUTED} {traced}",
        "page_decision": f"WITH {_ROUTED} SELECT doc_id, decision FROM ({traced}) WHERE page_index = 0",
        "doc_telemetry": f"WITH {_ROUTED} SELECT doc_id, kind AS category, avg_complexity AS overall_complexity, path AS routing_mode, CASE WHEN path = 'fast_path' THEN 85.0::DOUBLE ELSE 0.0::DOUBLE END AS resource_savings_pct FROM s",
        "page_plan": f"WITH {_FULL}, {steps} SELECT doc_id, page_index, array_to_string(l, ',') AS steps, array_to_string(list_transform(l, lambda v: {named('v', 0)}), ',') AS providers, array_to_string(list_transform(l, lambda v: {named('v', 1)}), ',') AS models, (len(l) * 15)::INT AS planned_ms FROM y",
        "plan_execution": f"WITH {_FULL}, {steps}, e AS (SELECT doc_id, page_index, unnest(l) AS c, unnest(range(len(l))) AS step FROM y) SELECT doc_id, page_index, step::INT AS step, 'execute_' || c AS decision, {named('c', 0)} AS provider_id, CASE c WHEN 'native_pdf' THEN 'NATIVE_EXTRACTION' WHEN 'ocr' THEN 'OCR' WHEN 'layout' THEN 'LAYOUT_ANALYSIS' WHEN 'table' THEN 'TABLE_RECOGNITION' WHEN 'formula' THEN 'FORMULA_RECOGNITION' ELSE 'POST_PROCESSING' END AS stage FROM e",
        "inspect_summary": f"WITH {_FULL}, z AS (SELECT doc_id, count(*)::INT AS pages, bool_or(scan_prob > 0.5) AS is_scanned, bool_or(has_tables) AS has_tables, bool_or(has_formulas) AS has_formulas, floor((2 * sum(round(ratio * 10000)::BIGINT)::BIGINT + count(*)) / (2 * count(*))) / 10000.0::DOUBLE AS avg_ratio, count_if(images > 0)::INT AS pages_with_images FROM x GROUP BY 1) SELECT *, NOT is_scanned AND avg_ratio >= 0.85 AS recommended_fast_path FROM z",
        "quality_gate": "WITH b AS (SELECT DISTINCT block_uid, doc_id, page_index, provenance.confidence AS c FROM blocks), t AS (SELECT doc_id, page_index, count(*) - 1 AS tries FROM raw_pages GROUP BY 1, 2), h AS (SELECT doc_id, page_index, sum(round(c * 10000)::BIGINT)::BIGINT AS s, count(c) AS n FROM b GROUP BY 1, 2), g AS (SELECT doc_id, page_index, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE floor((2 * s + n) / (2 * n)) / 10000.0::DOUBLE END AS confidence, coalesce(tries, 0) AS tries FROM h LEFT JOIN t USING (doc_id, page_index)) SELECT doc_id, page_index, confidence, confidence < 0.70 AND tries < 2 AS escalate FROM g",
        "page_class_check": f"WITH q AS (SELECT DISTINCT doc_id, page_index, coalesce(page_class, 'NONE') AS guessed, coalesce(char_count, 0) AS chars, coalesce(image_count, 0) AS images FROM raw_pages), {_PAGES}, j AS (SELECT q.doc_id, q.page_index, guessed, content_type AS ruled FROM q JOIN p ON q.doc_id = p.doc_id AND q.page_index = p.page_index AND q.chars = p.chars AND q.images = p.images) SELECT guessed, ruled, count(*) AS pages FROM j GROUP BY ROLLUP (guessed, ruled)",
        "provider_choice": _CHOICE,
        "provider_list": f"WITH {_PROVIDERS_SQL} SELECT policy, capability, provider_id FROM pr, (VALUES ('local_only'), ('remote_only'), ('remote_allowed')) v(policy) WHERE capability IN ('ocr', 'vlm') AND {allowed}",
        "ocr_choice": "SELECT DISTINCT doc_id AS request_id, CASE doc_id % 4 WHEN 1 THEN 'easyocr' WHEN 3 THEN 'remote_http' ELSE 'tesseract' END AS provider_id FROM files",
    }
