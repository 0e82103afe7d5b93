"""Queries of accuracy and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions.running import following
from pagewright.functions.tables import once, table
from pagewright.operators import metrics as M
from pagewright.plans.laying_out import _BOXES, _SP
from pagewright.plans.laying_out import _boxes as boxes


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with text and the next one of its file, as they are stored."""
    b = once(table(spark, sf_dir, "blocks").where("text is not null").select("block_uid", "doc_id", "page_index", "pos", F.col("text").alias("ref")), "block_uid")
    b = following(b, "doc_id", F.floor(F.col("page_index") / 50), ["page_index", "pos"], "ref", "hyp")
    return b.where("hyp is not null").select("block_uid", M.normalized_text(F.col("ref")).alias("ref"), M.normalized_text(F.col("hyp")).alias("hyp"))


_CER = "CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE round(levenshtein(ref, hyp) / length(ref)::DOUBLE, 4) END"
def _norm(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_SP}+', ' ', 'g')))"


def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.normalized_text(F.col("text"))).alias("digest"))


def text_norm_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.decomposed_text("text")).alias("digest"))


def text_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    cer, wer = M.character_error_rate(F.col("ref"), F.col("hyp"), M.text_distance), M.word_error_rate(F.col("ref"), F.col("hyp"))
    return p.select("block_uid", cer.alias("cer"), wer.alias("wer")).withColumn("char_accuracy", M.accuracy(F.col("cer"))).withColumn("word_accuracy", M.accuracy(F.col("wer")))


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = text_error_rates(spark, sf_dir)
    return r.select("block_uid", M.within_limits(F.col("cer"), F.col("wer"), F.lit(1.0)).alias("passed"))


def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("block_uid", F.round(M.ngram_score(M.words(F.col("ref")), M.words(F.col("hyp"))), 3).alias("bleu"))


def _jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages, and the same moved and resized a little, in whole thousandths."""
    b = boxes(spark, sf_dir).select("block_uid", "doc_id", "page_index", "pos", F.lower("block_type").alias("kind"), *[F.floor(F.col(x) * 1000 + 0.5).alias(x) for x in ("left", "top", "right", "bottom")])
    k = F.col("block_uid") % 7
    return b.withColumn("jl", F.col("left") + k * 4).withColumn("jt", F.col("top") - k).withColumn("jr", F.col("right") + k).withColumn("jb", F.col("bottom") + k * 2)


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jittered(spark, sf_dir)
    c = [F.col(x) / 1000.0 for x in ("left", "top", "right", "bottom")]
    d = [F.col(x) / 1000.0 for x in ("jl", "jt", "jr", "jb")]
    return j.select("block_uid", F.round(G.iou(tuple(c), tuple(d), 6), 3).alias("iou"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jittered(spark, sf_dir)
    box = lambda *c: F.array(*[F.col(x) / 1000.0 for x in c])
    lists = lambda b: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("kind").alias("type"), b.alias("box")))), lambda x: F.struct(x["type"].alias("type"), x["box"].alias("box")))
    return j.groupBy(F.concat_ws("/", "doc_id", "page_index").alias("case_id")).agg(lists(box("left", "top", "right", "bottom")).alias("gt"), lists(box("jl", "jt", "jr", "jb")).alias("pred"))


def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.layout_scores(_cases(spark, sf_dir))


def layout_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_precision(M.layout_scores(_cases(spark, sf_dir), (0.5, 0.6, 0.7, 0.8, 0.9)))


def layout_scores_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.layout_scores(_cases(spark, sf_dir), before=False)


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as tables of line items, as shipped and as received: some lines missing, some parts misread."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp"))
    cells = lambda d, part: d.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).cast("int").alias("row_index"), F.posexplode(F.array(part.cast("string"), F.col("supp").cast("string"))).alias("col_index", "text"))
    return cells(li, F.col("part")), cells(li.where("(l_orderkey + l_linenumber) % 5 != 0"), F.col("part") + F.col("l_orderkey") % 3)


_GRIDS = """li AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS r, max(l_partkey) AS part, max(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
    ref AS (SELECT table_id, r, 0 AS c, part::VARCHAR AS x FROM li UNION ALL SELECT table_id, r, 1, supp::VARCHAR FROM li),
    kept AS (SELECT * FROM li WHERE (table_id + r + 1) % 5 <> 0), hyp AS (SELECT table_id, r, 0 AS c, (part + table_id % 3)::VARCHAR AS x FROM kept UNION ALL SELECT table_id, r, 1, supp::VARCHAR FROM kept)"""


def table_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.table_similarity(*_grids(spark, sf_dir))
    return s.select("table_id", F.round("similarity", 3).alias("similarity"))


def table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.table_structure(*_grids(spark, sf_dir))
    return s.select("table_id", F.round("similarity", 3).alias("similarity"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_precision(*_grids(spark, sf_dir))


def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of blocks of each file against the kinds of those with a known provider."""
    b = table(spark, sf_dir, "blocks").select("block_uid", "doc_id", F.lower("block_type").alias("kind"), F.col("provenance.provider").alias("provider")).distinct()
    return M.multiset_scores(b, b.where("provider is not null"), "doc_id", "kind")


def formula_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("chunk_type = 'formula'").select("chunk_uid", "text").distinct()
    a, b = M.latex(F.col("text")), M.latex(F.concat(F.lit("$$"), F.col("text"), F.lit("  + x$$")))
    return c.select("chunk_uid", (a == b).alias("exact"), M.accuracy(M.character_error_rate(a, b)).alias("similarity"))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency(table(spark, sf_dir, "events"), "event_type", "value")


def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of even and odd users as two adapters, event types as cases; values in whole cents."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.when(F.col("user_id") % 2 == 0, "own").otherwise("other").alias("adapter")).agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double")).alias("total"))
    return M.compared(e, "event_type", "adapter", "total", "own", "other")


def case_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files times adapters: what a benchmark runs over."""
    adapters = F.explode(F.array(F.lit("own"), F.lit("external"))).alias("adapter")
    return table(spark, sf_dir, "files").select("doc_id", "doc_name").distinct().select("doc_id", adapters, "doc_name")


def run_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of their type that took so many seconds; purchases with a value above nothing succeeded."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return M.performance(e, "event_type", "value", ["ts", "event_id"], F.col("value") > 1, F.lit(3), F.col("user_id").cast("double"))


def inference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inference(table(spark, sf_dir, "events"), "event_type", "value")


def pipeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as processed documents: their pages, and the time of those pages at a fixed rate."""
    p = table(spark, sf_dir, "raw_pages").select("doc_id", "page_index", F.coalesce("char_count", F.lit(0)).alias("c")).distinct().groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.col("c") * 0.5 + 1).alias("ms"))
    f = table(spark, sf_dir, "files").select("doc_id").distinct().join(p, "doc_id", "left")
    return M.pipeline_metrics(f.select(F.when(F.col("pages").isNull(), "failed").otherwise("success").alias("status"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("ms", F.lit(0.0)).alias("ms")))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cases, of which every seventh failed: boxes, a heading's text and a table each where there are any."""
    c = _cases(spark, sf_dir)
    b = boxes(spark, sf_dir).withColumn("case_id", F.concat_ws("/", "doc_id", "page_index"))
    t = b.where("lower(block_type) = 'heading' and text is not null").groupBy("case_id").agg(F.min_by("text", "pos").alias("ref")).withColumn("hyp", F.concat("ref", F.lit(" x")))
    tables = b.where("lower(block_type) = 'table'").select("case_id", F.col("pos").alias("nth"), ((F.col("block_uid") % 10) / 10).alias("similarity"))
    cases = c.select("case_id", (F.split("case_id", "/")[1].cast("int") % 7 != 3).alias("success"))
    return M.accuracy_rows(cases, t, tables, c).withColumn("first_iou", F.round("first_iou", 3))


def first_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages as cases that all succeeded, how the first boxes overlap and the first table's score."""
    c = _cases(spark, sf_dir)
    b = boxes(spark, sf_dir).withColumn("case_id", F.concat_ws("/", "doc_id", "page_index"))
    tables = b.where("lower(block_type) = 'table'").select("case_id", F.col("pos").alias("nth"), ((F.col("block_uid") % 10) / 10).alias("similarity"))
    none = b.where("false").select("case_id", F.col("text").alias("ref"), F.col("text").alias("hyp"))
    return M.accuracy_rows(c.select("case_id", F.lit(True).alias("success")), none, tables, c).select("case_id", F.round("first_iou", 3).alias("first_iou"), F.col("table").alias("table_score"))


def queries() -> dict:
    return {
        "text_norm": text_norm, "text_norm_compat": text_norm_compat, "text_error_rates": text_error_rates, "regression_gate": regression_gate, "ngram_scores": ngram_scores, "box_overlap": box_overlap, "layout_scores": layout_scores,
        "layout_map": layout_map, "layout_scores_by_score": layout_scores_by_score, "table_similarity": table_similarity, "table_cells": table_cells, "structure_scores": structure_scores, "formula_scores": formula_scores,
        "table_structure": table_structure, "latency_stats": latency_stats, "run_performance": run_performance, "inference_stats": inference_stats, "accuracy": accuracy, "first_boxes": first_boxes, "bench_compare": bench_compare, "case_grid": case_grid, "pipeline_totals": pipeline_totals,
    }


def oracle_sql() -> dict[str, str]:
    jit = f"""{_BOXES}, j AS (SELECT *, l + k * 4 AS jl, t - k AS jt, r + k AS jr, b + k * 2 AS jb FROM (SELECT block_uid, doc_id, page_index, pos, block_type, block_uid % 7 AS k, floor(bl * 1000 + 0.5::DOUBLE)::BIGINT AS l, floor(bt * 1000 + 0.5::DOUBLE)::BIGINT AS t, floor(br * 1000 + 0.5::DOUBLE)::BIGINT AS r, floor(bb * 1000 + 0.5::DOUBLE)::BIGINT AS b FROM boxes)),
        i AS (SELECT *, greatest(0, least(r, jr) - greatest(l, jl)) * greatest(0, least(b, jb) - greatest(t, jt)) AS x, greatest(0, r - l) * greatest(0, b - t) + greatest(0, jr - jl) * greatest(0, jb - jt) AS s FROM j)"""
    # Greedy matches: of each page's predictions in turn, the best box not yet taken; g holds the candidates, the best first.
    pairs = f"""{jit}, y AS (SELECT doc_id || '/' || page_index AS id, lower(block_type) AS kind, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY pos) AS nth, l / 1000.0::DOUBLE AS l, t / 1000.0::DOUBLE AS t, r / 1000.0::DOUBLE AS r, b / 1000.0::DOUBLE AS b, jl / 1000.0::DOUBLE AS jl, jt / 1000.0::DOUBLE AS jt, jr / 1000.0::DOUBLE AS jr, jb / 1000.0::DOUBLE AS jb FROM j),
        v AS (SELECT p.id, p.nth AS pn, q.nth AS gn, least(p.jr, q.r) - greatest(p.jl, q.l) AS w, least(p.jb, q.b) - greatest(p.jt, q.t) AS h, (p.jr - p.jl) * (p.jb - p.jt) + (q.r - q.l) * (q.b - q.t) AS areas FROM y p JOIN y q ON p.id = q.id AND p.kind = q.kind),
        u AS (SELECT id, pn, gn, round(w * h / (areas - w * h), 4) AS iou FROM v WHERE w > 0 AND h > 0 AND areas - w * h > 0), th AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS least_)"""
    greedy = lambda before: f"""WITH RECURSIVE {pairs}, g AS (SELECT id, least_, pn, list(gn ORDER BY iou DESC, gn) AS gs, list(iou ORDER BY iou DESC, gn) AS ious FROM u, th WHERE {"iou >= least_" if before else "iou > 0"} GROUP BY 1, 2, 3),
        z1 AS (SELECT y.id, th.least_, y.nth, g.gs, g.ious FROM y CROSS JOIN th LEFT JOIN g ON g.id = y.id AND g.least_ = th.least_ AND g.pn = y.nth),
        m AS (SELECT id, least_, 0::BIGINT AS nth, []::BIGINT[] AS taken FROM (SELECT DISTINCT id, least_ FROM z1) UNION ALL SELECT id, least_, nth, CASE WHEN k IS NULL OR ious[k] < least_ THEN taken ELSE list_append(taken, gs[k]) END
          FROM (SELECT z1.*, m.taken, list_filter(range(1, len(coalesce(z1.gs, [])) + 1), lambda i: NOT list_contains(m.taken, z1.gs[i]))[1] AS k FROM m JOIN z1 ON z1.id = m.id AND z1.least_ = m.least_ AND z1.nth = m.nth + 1)),
        sc AS (SELECT id AS case_id, least_ AS threshold, max(nth) AS n, max(len(taken))::DOUBLE AS hits FROM m GROUP BY 1, 2), fin AS (SELECT case_id, threshold, round(hits / n, 4) AS precision, round(hits / n, 4) AS recall, round(2 * (hits / n) * (hits / n) / greatest(2 * hits / n, 1e-6::DOUBLE), 4) AS f1 FROM sc)"""  # noqa: E731
    over = lambda places: f"CASE WHEN x > 0 AND s - x > 0 THEN round(round(x / (s - x)::DOUBLE, {places}), 3) ELSE 0.0::DOUBLE END"
    gram = lambda side, n: f"SELECT block_uid, '{side}' AS side, {n} AS n, array_to_string({side}[i : i + {n - 1}], chr(31)) AS g FROM (SELECT *, unnest(range(1, greatest(len({side}) - {n} + 2, 1))) AS i FROM w)"
    grams = " UNION ALL ".join(gram(side, n) for side in "ab" for n in range(1, 5))
    bleu = f"""WITH p AS (SELECT block_uid, {_norm('ref')} AS ref, {_norm('hyp')} AS hyp FROM (SELECT block_uid, text AS ref, lead(text) OVER (PARTITION BY doc_id ORDER BY page_index, pos) AS hyp FROM (SELECT DISTINCT block_uid, doc_id, page_index, pos, text FROM blocks WHERE text IS NOT NULL)) WHERE hyp IS NOT NULL),
        w AS (SELECT block_uid, list_filter(string_split(ref, ' '), lambda x: x <> '') AS a, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS b FROM p),
        g AS ({grams}), c AS (SELECT block_uid, n, g, count_if(side = 'a') AS ca, count_if(side = 'b') AS cb FROM g GROUP BY 1, 2, 3), h AS (SELECT block_uid, n, sum(least(ca, cb)) AS hits FROM c GROUP BY 1, 2),
        q AS (SELECT w.block_uid, len(a) AS la, len(b) AS lb, r.n, ln(greatest(CASE WHEN len(b) >= r.n THEN coalesce(hits, 0) / (len(b) - r.n + 1)::DOUBLE ELSE 0.0::DOUBLE END, 1e-9::DOUBLE)) AS lp FROM w CROSS JOIN range(1, 5) r(n) LEFT JOIN h ON h.block_uid = w.block_uid AND h.n = r.n),
        z AS (SELECT block_uid, any_value(la) AS la, any_value(lb) AS lb, max(CASE n WHEN 1 THEN lp END) AS p1, max(CASE n WHEN 2 THEN lp END) AS p2, max(CASE n WHEN 3 THEN lp END) AS p3, max(CASE n WHEN 4 THEN lp END) AS p4 FROM q GROUP BY 1)
        SELECT block_uid, CASE WHEN la = 0 OR lb = 0 THEN 0.0::DOUBLE ELSE round(round(CASE WHEN lb >= la THEN 1.0::DOUBLE ELSE exp(1 - la / lb::DOUBLE) END * exp((p1 + p2 + p3 + p4) / 4), 4), 3) END AS bleu FROM z"""
    perf = """WITH e AS (SELECT event_type, event_id, ts, value AS s, value > 1 AS ok, user_id FROM events WHERE value IS NOT NULL), a AS (SELECT event_type, bool_or(ok) AS any_ok, arg_min(s, row(ts, event_id)) AS cold FROM e GROUP BY 1),
        f AS (SELECT e.*, cold FROM e JOIN a USING (event_type) WHERE ok OR NOT any_ok), g AS (SELECT event_type, count(*) AS runs, sum(round(s * 1e6::DOUBLE)::BIGINT)::BIGINT / 1e6::DOUBLE AS total, any_value(cold) AS cold, max(user_id) AS mb, list_sort(list(s)) AS l FROM f GROUP BY 1)
        SELECT event_type, runs, round(total, 4) AS total_sec, round(cold, 4) AS cold_start_sec, round(total / runs, 4) AS mean_sec, round(l[(runs // 2 + 1)::INT], 4) AS median_sec, round(l[(least(runs - 1, floor(runs * 0.95::DOUBLE)) + 1)::INT], 4) AS p95_sec, round(l[(least(runs - 1, floor(runs * 0.99::DOUBLE)) + 1)::INT], 4) AS p99_sec,
        round(1 / greatest(0.001::DOUBLE, total / runs), 2) AS docs_per_sec, round(3 / greatest(0.001::DOUBLE, total / runs), 2) AS pages_per_sec, round(mb::DOUBLE, 2) AS peak_mb FROM g"""
    return {
        "text_norm": f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents",
        "ngram_scores": bleu,
        "box_overlap": f"WITH {jit} SELECT block_uid, {over(6)} AS iou FROM i",
        "layout_scores": f"{greedy(True)} SELECT * FROM fin WHERE threshold = 0.5",
        "layout_map": f"{greedy(True)} SELECT case_id, round(avg(precision), 4) AS map FROM fin GROUP BY 1",
        "layout_scores_by_score": f"{greedy(False)} SELECT * FROM fin WHERE threshold = 0.5",
        "accuracy": f"""{greedy(True)}, mp AS (SELECT case_id, round(avg(precision), 4) AS layout_map FROM fin GROUP BY 1), hd AS (SELECT doc_id || '/' || page_index AS case_id, arg_min(text, pos) AS ref FROM boxes WHERE lower(block_type) = 'heading' AND text IS NOT NULL GROUP BY 1), nr AS (SELECT case_id, {_norm('ref')} AS r, {_norm("ref || ' x'")} AS h FROM hd),
            fb AS (SELECT doc_id || '/' || page_index AS case_id, arg_min({over(4)}, pos) AS first_iou, arg_min((block_uid % 10) / 10::DOUBLE, pos) FILTER (lower(block_type) = 'table') AS ts, any_value(page_index) % 7 <> 3 AS success FROM i GROUP BY 1)
            SELECT case_id, success, CASE WHEN success AND r IS NOT NULL THEN CASE WHEN r = '' THEN 1.0::DOUBLE ELSE round((length(h) - length(r)) / length(r)::DOUBLE, 4) END END AS cer, CASE WHEN success AND r IS NOT NULL THEN CASE WHEN r = '' THEN 1.0::DOUBLE ELSE round(1 / len(string_split(r, ' '))::DOUBLE, 4) END END AS wer,
            CASE WHEN success THEN ts END AS "table", CASE WHEN success THEN layout_map END AS layout_map, CASE WHEN success THEN first_iou END AS first_iou FROM fb LEFT JOIN mp USING (case_id) LEFT JOIN nr USING (case_id)""",
        "first_boxes": f"WITH {jit}, k AS (SELECT doc_id || '/' || page_index AS case_id, arg_min({over(4)}, pos) AS first_iou, arg_min(CASE WHEN lower(block_type) = 'table' THEN (block_uid % 10) / 10::DOUBLE END, pos) FILTER (lower(block_type) = 'table') AS table_score FROM i GROUP BY 1) SELECT * FROM k",
        "run_performance": perf,
        "inference_stats": "WITH e AS (SELECT event_type, count(*) AS runs, sum(round(value * 1e6::DOUBLE)::BIGINT)::BIGINT / 1e6::DOUBLE AS total, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, runs, round(total / runs, 2) AS mean_ms, round(l[(least(floor(runs * 0.95::DOUBLE), runs - 1) + 1)::INT], 2) AS p95_ms, round(CASE WHEN total > 0 THEN runs / (total / 1000) ELSE 0 END, 2) AS fps FROM e",
        "table_structure": f"WITH {_GRIDS}, s AS (SELECT * FROM (SELECT table_id, max(r) + 1 AS ar, max(c) + 1 AS ac FROM ref GROUP BY 1) FULL JOIN (SELECT table_id, max(r) + 1 AS br, max(c) + 1 AS bc FROM hyp GROUP BY 1) USING (table_id)), a AS (SELECT table_id, x, count(*) AS n FROM ref GROUP BY 1, 2), b AS (SELECT table_id, x, count(*) AS m FROM hyp GROUP BY 1, 2), t AS (SELECT a.table_id, sum(least(n, coalesce(m, 0))) AS common, sum(n) AS total FROM a LEFT JOIN b ON a.table_id = b.table_id AND a.x = b.x GROUP BY 1) SELECT table_id, round(CASE WHEN ar IS NULL OR br IS NULL THEN 0.0::DOUBLE ELSE round(0.4::DOUBLE * (1 - abs(ar - br) / greatest(ar, br)::DOUBLE) + 0.4::DOUBLE * (1 - abs(ac - bc) / greatest(ac, bc)::DOUBLE) + 0.2::DOUBLE * coalesce(common, 0) / greatest(coalesce(total, 0), 1), 4) END, 3) AS similarity FROM s LEFT JOIN t USING (table_id)",
        "table_similarity": f"WITH {_GRIDS}, s AS (SELECT * FROM (SELECT table_id, max(r) + 1 AS ar, max(c) + 1 AS ac FROM ref GROUP BY 1) JOIN (SELECT table_id, max(r) + 1 AS br, max(c) + 1 AS bc FROM hyp GROUP BY 1) USING (table_id)), q AS (SELECT a.table_id, sum(round((1 - least(1.0::DOUBLE, round(levenshtein(a.x, b.x) / length(a.x)::DOUBLE, 4))) * 10000)::BIGINT)::BIGINT / (count(*) * 10000.0::DOUBLE) AS cells FROM ref a JOIN hyp b ON a.table_id = b.table_id AND a.r = b.r AND a.c = b.c GROUP BY 1) SELECT table_id, round(round(0.5::DOUBLE * (1 - (abs(ar - br) + abs(ac - bc)) / (ar + ac + br + bc)::DOUBLE) + 0.5::DOUBLE * coalesce(cells, 0.0::DOUBLE), 4), 3) AS similarity FROM s LEFT JOIN q USING (table_id)",
        "table_cells": f"WITH {_GRIDS}, n AS (SELECT table_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT table_id, count(*) AS a FROM ref GROUP BY 1) FULL JOIN (SELECT table_id, count(*) AS b FROM hyp GROUP BY 1) USING (table_id)), h AS (SELECT table_id, count(*) AS hits FROM hyp WHERE EXISTS (SELECT 1 FROM ref WHERE ref.table_id = hyp.table_id AND ref.x = hyp.x) GROUP BY 1) SELECT table_id, round(coalesce(hits, 0) / greatest(a, b)::DOUBLE, 4) AS score FROM n LEFT JOIN h USING (table_id)",
        "structure_scores": "WITH d AS (SELECT DISTINCT block_uid, doc_id, lower(block_type) AS kind, provenance.provider AS pr FROM blocks), j AS (SELECT doc_id, kind, count(*) AS a, count(pr) AS b FROM d GROUP BY 1, 2), g AS (SELECT doc_id, sum(least(a, b))::DOUBLE AS m, sum(a) AS na, sum(b) AS nb FROM j GROUP BY 1), s AS (SELECT doc_id, CASE WHEN nb > 0 THEN m / nb ELSE 0.0::DOUBLE END AS p, CASE WHEN na > 0 THEN m / na ELSE 0.0::DOUBLE END AS r FROM g) SELECT doc_id, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / greatest(p + r, 1e-6::DOUBLE), 4) AS f1 FROM s",
        "formula_scores": r"WITH c AS (SELECT DISTINCT chunk_uid, text FROM chunks WHERE chunk_type = 'formula'), x AS (SELECT chunk_uid, trim(regexp_replace(regexp_replace(text, '^\$+|\$+$', '', 'g'), '\s+', ' ', 'g')) AS ref, trim(regexp_replace(regexp_replace('$$' || text || '  + x$$', '^\$+|\$+$', '', 'g'), '\s+', ' ', 'g')) AS hyp FROM c) SELECT chunk_uid, ref = hyp AS exact, greatest(0.0::DOUBLE, round(1 - " + _CER + ", 4)) AS similarity FROM x",
        "latency_stats": "WITH v AS (SELECT event_type, list_sort(list(value)) AS l, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, n, l[(n // 2 + 1)::INT] AS median, l[(least(n - 1, floor(n * 0.95::DOUBLE)) + 1)::INT] AS p95, l[(least(n - 1, floor(n * 0.99::DOUBLE)) + 1)::INT] AS p99 FROM v",
        "bench_compare": "WITH e AS (SELECT event_type, (sum(CASE WHEN user_id % 2 = 0 THEN round(value * 100)::BIGINT END))::DOUBLE AS base, (sum(CASE WHEN user_id % 2 <> 0 THEN round(value * 100)::BIGINT END))::DOUBLE AS other FROM events GROUP BY 1), p AS (SELECT *, CASE WHEN base <> 0 THEN round((other - base) * 100.0::DOUBLE / base, 2) END AS change_pct FROM e) SELECT event_type, base, other, change_pct, CASE WHEN change_pct < -5 THEN 'better' WHEN change_pct > 5 THEN 'worse' ELSE 'equal' END AS verdict FROM p",
        "case_grid": "SELECT DISTINCT doc_id, adapter, doc_name FROM files, (VALUES ('own'), ('external')) v(adapter)",
        "pipeline_totals": "WITH p AS (SELECT doc_id, count(*) AS pages, sum(c * 0.5::DOUBLE + 1) AS ms FROM (SELECT DISTINCT doc_id, page_index, coalesce(char_count, 0) AS c FROM raw_pages) GROUP BY 1), f AS (SELECT pages, ms FROM (SELECT DISTINCT doc_id FROM files) LEFT JOIN p USING (doc_id)), g AS (SELECT count(*) AS documents, count_if(pages IS NULL)::BIGINT AS failed, sum(pages)::BIGINT AS pages, sum(ms) AS total_ms FROM f) SELECT *, round(total_ms / pages, 4) AS ms_per_page, round(pages / (total_ms / 1000), 2) AS pages_per_sec FROM g",
    }
