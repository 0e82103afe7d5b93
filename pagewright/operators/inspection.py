"""What pages and documents are like, and which way they are processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.means import mean
from pagewright.functions.skew import split_join

# Thresholds of the rules below.
FULL_TEXT, SOME_TEXT, DENSE = 50, 20, 2500.0
CAPABILITY_MS = 15
# Paths of pages and documents; kinds of documents.
FAST_PATH, DEEP_ML, VLM_FALLBACK = "fast_path", "deep_ml", "vlm_fallback"
DIGITAL_PDF, SCANNED_DOCUMENT, COMPLEX_MULTI_COLUMN, FORM_INVOICE, TECHNICAL_REPORT = "digital_pdf", "scanned_document", "complex_multi_column", "form_invoice", "technical_report"
# Steps of a page's plan, in their order, each with its provider and model.
STEPS = {
    "native_pdf": ("native_pdf_backend", "pdfminer_engine"),
    "ocr": ("rapidocr", "rapidocr_onnx"),
    "layout": ("rtdetr_layout", "rtdetr_doclaynet"),
    "table": ("slanet_table", "slanet_v1"),
    "figure": ("local_figure_analyzer", "basic_figure_v1"),
    "formula": ("local_formula_recognizer", "texify_v1"),
}
# What a trace says of the two ways a document is processed.
FAST_DECISION, DEEP_DECISION = "FAST_PATH_NATIVE_EXTRACTION", "DEEP_ML_LAYOUT_AND_OCR"
FAST_REASON = "Clean digital vector text layer detected (text_ratio >= 0.85). Bypassed heavy ML models."
FAST_SAVINGS = 85.0
# Providers tried by default, by capability.
CHAINS = {
    "ocr": ["ocr.rapidocr", "ocr.surya", "ocr.tesseract", "ocr.remote"],
    "layout": ["layout.rtdetr", "layout.yolo"],
    "table": ["table.slanet"],
    "vlm": ["vlm.local", "vlm.huggingface", "vlm.remote"],
}
OCR_CHAIN = ["rapidocr", "tesseract", "remote_http"]


def content_type(chars: Column, images: Column) -> Column:
    return F.when((chars >= FULL_TEXT) & (images == 0), "DIGITAL_TEXT_ONLY").when((chars < SOME_TEXT) & (images > 0), "SCANNED_IMAGE_ONLY").when((chars >= SOME_TEXT) & (images > 0), "HYBRID").otherwise("EMPTY")


def text_density(chars: Column) -> Column:
    return F.least(F.lit(1.0), F.round(chars / DENSE, 4))


def image_coverage(areas: Column, page_area: Column) -> Column:
    """Of an array of image areas; at most 1."""
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), F.when(page_area > 0, total / page_area).otherwise(0.0))


def image_dpi(pixels: Column, points: Column) -> Column:
    return F.when(points > 0, F.round(pixels / (points / 72.0), 1))


def document_category(pages: DataFrame) -> DataFrame:
    """doc_id, content_type, coverage, density, chars of each page -> doc_id, category, n_pages and signals: has_native_text,
    fast_path, ocr_suggested, vlm_suggested, avg_density, scanned_ratio."""
    kind = F.col("content_type")
    count = lambda *k: F.count_if(kind.isin(*k))
    g = pages.groupBy("doc_id").agg(F.count("*").alias("n"), count("SCANNED_IMAGE_ONLY").alias("scanned"), count("SCANNED_IMAGE_ONLY", "EMPTY").alias("no_text"), count("DIGITAL_TEXT_ONLY").alias("digital"), count("DIGITAL_TEXT_ONLY", "HYBRID").alias("with_text"), mean(F.col("coverage"), 6).alias("coverage"), F.sum("chars").alias("chars"), mean(F.col("density"), 4).alias("avg_density"))
    n = F.col("n")
    category = F.when((F.col("scanned") == n) & (F.col("coverage") >= 0.70), "IMAGE_ONLY").when(F.col("no_text") / n >= 0.75, "SCANNED")
    category = category.when((F.col("digital") == n) | ((F.col("with_text") == n) & (F.col("coverage") < 0.35)), "DIGITALLY_GENERATED").otherwise("HYBRID")
    return g.select("doc_id", category.alias("category"), n.cast("int").alias("n_pages"), (F.col("chars") > 20).alias("has_native_text"), (category == "DIGITALLY_GENERATED").alias("fast_path"), category.isin("SCANNED", "IMAGE_ONLY", "HYBRID").alias("ocr_suggested"), (category == "IMAGE_ONLY").alias("vlm_suggested"), "avg_density", F.round(F.col("no_text") / n, 4).alias("scanned_ratio"))


def characteristics(pages: DataFrame) -> DataFrame:
    """Adds ratio, scan_prob and image_density to pages with format, content_type, density and images. Files that
    aren't pdf are taken as digital."""
    pdf = F.col("format") == "pdf"
    scan = F.when(F.col("content_type") == "SCANNED_IMAGE_ONLY", 1.0).when(F.col("density") > 0.8, 0.0).otherwise(0.5)
    return pages.withColumn("ratio", F.when(pdf, F.col("density")).otherwise(1.0)).withColumn("scan_prob", F.when(pdf, scan).otherwise(0.0)).withColumn("image_density", F.when(pdf & (F.col("images") > 0), 0.8).otherwise(0.0))


def complexity() -> Column:
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    score = 0.4 * (1.0 - F.col("ratio")) + 0.3 * F.col("scan_prob") + 0.2 * F.col("image_density") + 0.1 * flag("has_tables") + 0.1 * flag("has_figures") + 0.15 * flag("has_formulas")
    return F.least(F.lit(1.0), score)


def page_path(c: Column) -> Column:
    fast = (F.col("ratio") >= 0.85) & (F.col("scan_prob") < 0.15) & ~F.col("has_tables") & ~F.col("has_formulas")
    hard = (F.col("scan_prob") >= 0.80) | (c >= 0.75)
    return F.when(fast, FAST_PATH).when(hard & (F.col("image_density") >= 0.7), VLM_FALLBACK).otherwise(DEEP_ML)


def document_routing(pages: DataFrame, category: DataFrame) -> DataFrame:
    """Pages with complexity and flags, category of documents -> doc_id, kind, average complexity, path."""
    g = pages.groupBy("doc_id").agg(F.bool_or("has_formulas").alias("formulas"), F.bool_or("has_tables").alias("tables"), F.bool_or("has_figures").alias("figures"), mean(F.col("complexity"), 6).alias("avg"), mean(F.col("complexity"), 6, 2).alias("avg_complexity"))
    g = g.join(category.select("doc_id", "category"), "doc_id")
    avg = F.col("avg")
    kind = F.when(F.col("category") == "SCANNED", SCANNED_DOCUMENT).when(F.col("formulas"), TECHNICAL_REPORT).when(F.col("tables") & (avg > 0.5), FORM_INVOICE).when(F.col("figures") & (avg > 0.4), COMPLEX_MULTI_COLUMN).otherwise(DIGITAL_PDF)
    path = F.when(kind.isin(SCANNED_DOCUMENT, COMPLEX_MULTI_COLUMN, TECHNICAL_REPORT), DEEP_ML).when(avg >= 0.7, VLM_FALLBACK).otherwise(FAST_PATH)
    return g.select("doc_id", kind.alias("kind"), "avg_complexity", path.alias("path"))


def decisions(pages: DataFrame, routing: DataFrame) -> DataFrame:
    """doc_id, page_index, complexity of pages; path of documents -> what was decided for each page, why, and by what:
    a page is processed as its document is routed, whatever its own path. Documents of many pages are split."""
    d = split_join(pages.select("doc_id", "page_index", "complexity"), routing.select("doc_id", "path"), ["doc_id"], ["page_index"])
    fast = F.col("path") == FAST_PATH
    deep = F.concat(F.lit("Scanned/complex page (complexity: "), F.round("complexity", 2).cast("string"), F.lit(f"). Escalated to {STEPS['layout'][0]} and default OCR."))
    return d.select("doc_id", "page_index", F.when(fast, FAST_DECISION).otherwise(DEEP_DECISION).alias("decision"), F.when(fast, FAST_REASON).otherwise(deep).alias("reason"), F.when(fast, STEPS["native_pdf"][0]).otherwise(STEPS["layout"][0]).alias("provider_id"), F.lit("LOCAL").alias("mode"))


def telemetry(routing: DataFrame) -> DataFrame:
    """One row a document: kind, complexity, routing and the share of resources saved."""
    return routing.select("doc_id", F.col("kind").alias("category"), F.col("avg_complexity").alias("overall_complexity"), F.col("path").alias("routing_mode"), F.when(F.col("path") == FAST_PATH, FAST_SAVINGS).otherwise(0.0).alias("resource_savings_pct"))


def capabilities() -> Column:
    """Steps that a page needs, in order."""
    native = (F.col("format") == "pdf") & (F.col("ratio") >= 0.8) & (F.col("scan_prob") < 0.2)
    layout = (F.col("scan_prob") >= 0.5) | (F.col("image_density") > 0.3) | F.col("has_tables")
    return F.array_compact(F.array(F.when(native, "native_pdf").otherwise("ocr"), F.when(layout, "layout"), F.when(F.col("has_tables"), "table"), F.when(F.col("has_figures"), "figure"), F.when(F.col("has_formulas"), "formula")))


def planned(steps: Column, which: int) -> Column:
    """The providers (0) or models (1) of a page's steps."""
    m = F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, v[which])])
    return F.transform(steps, lambda x: F.element_at(m, x))


def execution(plans: DataFrame) -> DataFrame:
    """Plans (doc_id, page_index, steps) -> a trace row for each step, in order, and what stage its result has."""
    stage = {"native_pdf": "NATIVE_EXTRACTION", "ocr": "OCR", "layout": "LAYOUT_ANALYSIS", "table": "TABLE_RECOGNITION", "figure": "POST_PROCESSING", "formula": "FORMULA_RECOGNITION"}
    m = F.create_map(*[F.lit(x) for kv in stage.items() for x in kv])
    p = F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, v[0])])
    e = plans.select("doc_id", "page_index", F.posexplode("steps").alias("step", "capability"))
    return e.select("doc_id", "page_index", "step", F.concat(F.lit("execute_"), "capability").alias("decision"), F.element_at(p, F.col("capability")).alias("provider_id"), F.element_at(m, F.col("capability")).alias("stage"))


def planned_ms(steps: Column) -> Column:
    return F.size(steps) * CAPABILITY_MS


def quality_gate(regions: DataFrame, least: float = 0.70, most_retries: int = 2, escalation: bool = True) -> DataFrame:
    """doc_id, page_index, confidence of regions, retry_count of their page (0 if there is no such column) -> the pages'
    mean confidence and whether they go to a vision model. A page without confidences has 1."""
    retries = F.max("retry_count") if "retry_count" in regions.columns else F.lit(0)
    g = regions.groupBy("doc_id", "page_index").agg(mean(F.col("confidence"), 4).alias("mean"), retries.alias("retries"))
    conf = F.coalesce("mean", F.lit(1.0))
    again = (F.coalesce("retries", F.lit(0)) < most_retries) & F.lit(escalation) & (conf < least)
    return g.select("doc_id", "page_index", conf.alias("confidence"), again.alias("escalate"))


def summary(pages: DataFrame) -> DataFrame:
    """One row a document: page counts and what is recommended."""
    g = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"), F.bool_or(F.col("scan_prob") > 0.5).alias("is_scanned"), F.bool_or("has_tables").alias("has_tables"), F.bool_or("has_formulas").alias("has_formulas"), mean(F.col("ratio"), 4).alias("avg_ratio"), F.count_if(F.col("images") > 0).cast("int").alias("pages_with_images"))
    return g.withColumn("recommended_fast_path", ~F.col("is_scanned") & (F.col("avg_ratio") >= 0.85))


def listed_providers(providers: DataFrame, capability: str | None = None, policy: str | None = None) -> DataFrame:
    """Providers of a capability that a privacy policy (local_only, remote_only, others) allows."""
    p = providers if capability is None else providers.where(F.col("capability") == capability)
    return p.where(~F.col("remote")) if policy == "local_only" else p.where("remote") if policy == "remote_only" else p


def _candidates(capability: Column) -> Column:
    c = F.when(capability == next(iter(CHAINS)), F.array(*map(F.lit, CHAINS[next(iter(CHAINS))])))
    for k, names in list(CHAINS.items())[1:]:
        c = c.when(capability == k, F.array(*map(F.lit, names)))
    return c.otherwise(F.array(F.concat(capability, F.lit(".local"))))


def choose_provider(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """request_id, capability, policy, page_override, override, priority (array; null for the default chain) -> every attempt
    up to the first provider chosen: request_id, attempt, provider_id, result (SELECTED, SKIPPED, FAILED), why.

    An override, of the page before that of all pages, is taken without a look at its health, unless it is remote and
    the policy is local_only; then the candidates follow in order. providers: provider_id, remote, available, a table of few
    rows. A request for which none is left ends with its failures."""
    over = F.coalesce("page_override", "override")
    chain = F.when(F.size(F.coalesce("priority", F.array().cast("array<string>"))) > 0, F.col("priority")).otherwise(_candidates(F.col("capability")))
    tries = F.concat(F.array_compact(F.array(over)), chain)
    c = requests.select("request_id", "policy", over.isNotNull().alias("has_override"), F.posexplode(tries).alias("i", "provider_id"))
    c = c.withColumn("key", F.lower("provider_id")).join(F.broadcast(providers.select(F.lower("provider_id").alias("key"), "remote", "available")), "key", "left")
    first = F.col("has_override") & (F.col("i") == 0)
    closed = (F.col("policy") == "local_only") & F.col("remote") | ~first & (F.col("policy") == "remote_only") & ~F.col("remote")
    result = F.when(F.col("remote").isNull(), "FAILED").when(closed, "SKIPPED").when(first | F.col("available"), "SELECTED").otherwise("FAILED")
    why = F.when(F.col("remote").isNull(), "not registered").when(closed, "policy").when(first, "override").when(F.col("available"), "chain").otherwise("health")
    c = c.withColumn("attempt", F.col("i") + 1).withColumn("result", result).withColumn("why", why)
    before = Window.partitionBy("request_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("chosen", F.coalesce(F.count_if(F.col("result") == "SELECTED").over(before), F.lit(0)))
    return c.where("chosen = 0").select("request_id", "attempt", "provider_id", "result", "why")


def choose_ocr(requests: DataFrame, providers: DataFrame, chain: list[str] | None = None) -> DataFrame:
    """request_id, requested -> request_id, provider_id: the one asked for (unless auto) if it is available, else the first of
    the chain that is, else the first of all by name; null where none is. providers: provider_id, available, a table of few rows."""
    ready = sorted(r.name for r in providers.where("available").select(F.lower("provider_id").alias("name")).collect())
    chain = [x.lower() for x in chain or OCR_CHAIN]
    first = next((x for x in chain if x in ready), ready[0] if ready else None)
    asked = F.lower("requested")
    return requests.select("request_id", F.when(asked.isin(ready), asked).otherwise(F.lit(first).cast("string")).alias("provider_id"))


def is_healthy(device_ok: Column, remote: Column, endpoint: Column, needs_key: Column, key: Column) -> Column:
    return device_ok & (~remote | (F.coalesce(endpoint, F.lit("")) != "")) & (~needs_key | (F.coalesce(key, F.lit("")) != ""))
