"""How well extraction agrees with what was meant: text, boxes, tables, formulas, structure; and how fast it is."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.geometry import iou
from pagewright.functions.means import units
from pagewright.functions.ranks import at_ranks
from pagewright.functions.strings import SPACE

# Limits of the regression gate.
LIMITS = {"cer": 0.15, "wer": 0.25, "layout_f1": 0.70, "latency_increase": 0.20}


def normalized_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))


@F.pandas_udf(T.StringType())
def decomposed_text(s: pd.Series) -> pd.Series:
    """As normalized_text, after compatibility decomposition."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKD", x).split()).lower(), na_action="ignore")


def _rate(edits: Column, size: Column, other: Column) -> Column:
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(F.round(edits / size, 4))


def edits(a: Sequence, b: Sequence) -> int:
    """Edit distance of texts or lists, a whole column of the table at a time as bits of a number."""
    if len(a) < len(b):  # one step for each of the fewer, bits for the others
        a, b = b, a
    if len(b) == 0:
        return len(a)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last, n = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for y in b:
        eq = at.get(y, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        more, less = down | every & ~(same | up), up & same
        n += ((more & last) != 0) - ((less & last) != 0)
        more, less = (more << 1 | 1) & every, less << 1 & every
        same = eq | down
        up, down = less | every & ~(same | more), more & same
    return n


@F.pandas_udf(T.IntegerType())
def text_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """As levenshtein, for long texts."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def character_error_rate(ref: Column, hyp: Column, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """Edits per character of the reference, 4 places; may exceed 1."""
    return _rate(distance(ref, hyp), F.length(ref), F.length(hyp))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


@F.pandas_udf(T.IntegerType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two arrays of strings."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    a, b = words(ref), words(hyp)
    return _rate(sequence_distance(a, b), F.size(a), F.size(b))


def accuracy(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(1 - rate, 4))


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return round(w * h / union, 4) if union > 0 else 0.0


def greedy_scores(gt: list, pred: list, least: float, before: bool = True) -> tuple[float, float, float]:
    """Precision, recall and F1 of (type, box) lists: each prediction in turn takes the best box of its type not yet taken.

    before: only boxes that overlap enough are looked at; otherwise the best is chosen first, and a prediction without
    a box is wrong."""
    if not gt and not pred:
        return 1.0, 1.0, 1.0
    if not gt or not pred:
        return 0.0, 0.0, 0.0
    taken: set[int] = set()
    hits = 0
    for kind, box in pred:
        best, at = (least if before else 0.0), -1
        for i, (k, g) in enumerate(gt):
            if i in taken or k != kind or g is None or box is None:
                continue
            x = _iou(box, g)
            if x > best or before and at < 0 and x >= least:
                best, at = x, i
        if at >= 0 and best >= least:
            taken.add(at)
            hits += 1
    p, r = hits / len(pred), hits / len(gt)
    return round(p, 4), round(r, 4), round(2 * p * r / max(p + r, 1e-6), 4)


def layout_scores(cases: DataFrame, thresholds: tuple[float, ...] = (0.5,), before: bool = True) -> DataFrame:
    """case_id, gt and pred (arrays of type and box, predictions in order) -> threshold, precision, recall, f1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, gt, pred in zip(pdf["case_id"], pdf["gt"], pdf["pred"], strict=True):
                g, p = ([(x["type"], x["box"]) for x in (xs if xs is not None else [])] for xs in (gt, pred))
                rows += [(case, t, *greedy_scores(g, p, t, before)) for t in thresholds]
            yield pd.DataFrame(rows, columns=["case_id", "threshold", "precision", "recall", "f1"])

    return cases.select("case_id", "gt", "pred").mapInPandas(run, "case_id string, threshold double, precision double, recall double, f1 double")


def mean_precision(scores: DataFrame) -> DataFrame:
    return scores.groupBy("case_id").agg(F.round(F.avg("precision"), 4).alias("map"))


def table_similarity(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Cells (table_id, row_index, col_index, text) of both -> half for the size of the grid, half for the mean accuracy of
    the cells in the rectangle they share."""
    size = lambda d, p: d.groupBy("table_id").agg((F.max("row_index") + 1).alias(f"{p}r"), (F.max("col_index") + 1).alias(f"{p}c"))
    s = size(ref, "a").join(size(hyp, "b"), "table_id")
    grid = 1 - (F.abs(F.col("ar") - F.col("br")) + F.abs(F.col("ac") - F.col("bc"))) / (F.col("ar") + F.col("ac") + F.col("br") + F.col("bc"))
    both = ref.select("table_id", "row_index", "col_index", F.col("text").alias("x")).join(hyp.select("table_id", "row_index", "col_index", F.col("text").alias("y")), ["table_id", "row_index", "col_index"])
    right = units(1 - F.least(F.lit(1.0), character_error_rate(F.col("x"), F.col("y"))), 4)
    cell = both.groupBy("table_id").agg((F.sum(right) / (F.count("*") * 10_000.0)).alias("cells"))
    return s.join(cell, "table_id", "left").select("table_id", F.round(0.5 * grid + 0.5 * F.coalesce("cells", F.lit(0.0)), 4).alias("similarity"))


def _tokens(cells: DataFrame, name: str) -> DataFrame:
    """table_id, token, how often it occurs in the table's cells."""
    t = cells.select("table_id", F.explode(words(normalized_text(F.col("text")))).alias("token"))
    return t.groupBy("table_id", "token").agg(F.count("*").alias(name))


def table_structure(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Cells of both -> 0.4 for the rows, 0.4 for the columns (less their relative difference), 0.2 for the share of the
    reference's tokens that the other has; tables that only one side has come out with 0."""
    size = lambda d, p: d.groupBy("table_id").agg((F.max("row_index") + 1).alias(f"{p}r"), (F.max("col_index") + 1).alias(f"{p}c"))
    s = size(ref, "a").join(size(hyp, "b"), "table_id", "full")
    j = _tokens(ref, "a").join(_tokens(hyp, "b"), ["table_id", "token"], "left")
    t = j.groupBy("table_id").agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("common"), F.sum("a").alias("total"))
    near = lambda x: 1 - F.abs(F.col(f"a{x}") - F.col(f"b{x}")) / F.greatest(f"a{x}", f"b{x}")
    score = 0.4 * near("r") + 0.4 * near("c") + 0.2 * F.coalesce("common", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))
    return s.join(t, "table_id", "left").select("table_id", F.when(F.col("ar").isNull() | F.col("br").isNull(), 0.0).otherwise(F.round(score, 4)).alias("similarity"))


def html_similarity(ref: Column, hyp: Column) -> Column:
    """Of tables given as HTML: 1 if they are equal, else a half."""
    return F.when(ref == hyp, 1.0).otherwise(0.5)


def cell_precision(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Share of cells whose text is some cell of the reference, by the larger number of cells."""
    n = ref.groupBy("table_id").agg(F.count("*").alias("a")).join(hyp.groupBy("table_id").agg(F.count("*").alias("b")), "table_id", "full").fillna(0)
    hits = hyp.join(ref.select("table_id", "text").distinct(), ["table_id", "text"], "left_semi").groupBy("table_id").agg(F.count("*").alias("hits"))
    return n.join(hits, "table_id", "left").select("table_id", F.round(F.coalesce("hits", F.lit(0)) / F.greatest("a", "b"), 4).alias("score"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _clipped(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """How many n-grams of b are in a, each as often as it is there at most; for n up to most."""
    grams = lambda x, n: Counter(zip(*[x[i:] for i in range(n)]))
    return pd.Series([None if x is None or y is None else [(grams(x, n) & grams(y, n)).total() for n in range(1, m + 1)] for x, y, m in zip(a, b, most, strict=True)])


def ngram_score(ref: Column, hyp: Column, most: int = 4) -> Column:
    """Geometric mean of clipped n-gram precisions (at least 1e-9) with a penalty for brevity, of arrays of words."""
    clipped = _clipped(ref, hyp, F.lit(most))

    def precision(n: int) -> Column:
        return F.greatest(F.when(F.size(hyp) >= n, clipped[n - 1] / (F.size(hyp) - n + 1)).otherwise(0.0), F.lit(1e-9))

    logs = [F.log(precision(n)) for n in range(1, most + 1)]
    brief = F.when(F.size(hyp) >= F.size(ref), 1.0).otherwise(F.exp(1 - F.size(ref) / F.greatest(F.size(hyp), F.lit(1))))
    return F.when((F.size(ref) == 0) | (F.size(hyp) == 0), 0.0).otherwise(F.round(brief * F.exp(sum(logs[1:], logs[0]) / most), 4))


def latex(c: Column) -> Column:
    """A formula without marks of mode and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\$+|\$+$", ""), r"\s+", " "))


def multiset_scores(ref: DataFrame, hyp: DataFrame, case: str, item: str) -> DataFrame:
    """Precision, recall and F1 of what both have in common, with multiplicity."""
    a = ref.groupBy(case, item).agg(F.count("*").alias("a"))
    b = hyp.groupBy(case, item).agg(F.count("*").alias("b"))
    j = a.join(b, [case, item], "full").fillna(0, ["a", "b"])
    g = j.groupBy(case).agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = F.when(F.col("nb") > 0, F.col("both") / F.col("nb")).otherwise(0.0)
    r = F.when(F.col("na") > 0, F.col("both") / F.col("na")).otherwise(0.0)
    return g.select(case, F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-6)), 4).alias("f1"))


def latency(runs: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, median (the upper of two), p95 and p99 by index, without interpolation."""
    at = lambda q: lambda n: F.least(n - 1, F.floor(n * F.lit(q)))
    return at_ranks(runs, by, value, {"median": lambda n: F.floor(n / 2), "p95": at(0.95), "p99": at(0.99)})


def performance(runs: DataFrame, by: str, seconds: str, order: list[str], success: Column | None = None, pages: Column | None = None, memory: Column | None = None) -> DataFrame:
    """Runs of each case -> runs, total_sec, cold_start_sec (the first run's), mean_sec, median_sec, p95_sec, p99_sec, docs_per_sec,
    pages_per_sec (a mean below a millisecond counts as one) and peak_mb. Failed runs don't count where any succeeded."""
    ok = F.lit(True) if success is None else success
    d = runs.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_s", F.col(seconds).cast("double")).withColumn("_pages", F.lit(1) if pages is None else pages).withColumn("_mb", F.lit(0.0) if memory is None else memory).where("_s is not null")
    good = d.groupBy(by).agg(F.bool_or("_ok").alias("_any"), F.min_by("_s", F.struct(*order)).alias("_cold"))
    few = good.count() <= 20_000  # a row for each case
    d = d.join(F.broadcast(good) if few else good, by).where("_ok or not _any")
    total = F.sum(units(F.col("_s"), 6)) / 1e6
    g = d.groupBy(by).agg(F.count("*").alias("runs"), total.alias("_total"), F.max("_pages").alias("_pages"), F.max("_mb").alias("_mb"), F.first("_cold").alias("_cold"))
    g = g.join(latency(d.select(by, "_s"), by, "_s").drop("n"), by)
    mean = F.col("_total") / F.col("runs")
    floor = F.greatest(F.lit(0.001), mean)
    return g.select(
        by, "runs", F.round("_total", 4).alias("total_sec"), F.round("_cold", 4).alias("cold_start_sec"), F.round(mean, 4).alias("mean_sec"), *[F.round(x, 4).alias(f"{x}_sec") for x in ("median", "p95", "p99")],
        F.round(1 / floor, 2).alias("docs_per_sec"), F.round(F.greatest(F.lit(1), F.col("_pages")) / floor, 2).alias("pages_per_sec"), F.round("_mb", 2).alias("peak_mb"),
    )


def inference(runs: DataFrame, by: str, ms: str) -> DataFrame:
    """Timed runs -> runs, mean_ms, p95_ms and fps, the runs a second of the time they took."""
    p = at_ranks(runs, by, ms, {"p95": lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1)})
    g = runs.where(F.col(ms).isNotNull()).groupBy(by).agg((F.sum(units(F.col(ms), 6)) / 1e6).alias("_total"))
    fps = F.when(F.col("_total") > 0, F.col("n") / (F.col("_total") / 1000)).otherwise(0.0)
    return p.join(g, by).select(by, F.col("n").alias("runs"), F.round(F.col("_total") / F.col("n"), 2).alias("mean_ms"), F.round("p95", 2).alias("p95_ms"), F.round(fps, 2).alias("fps"))


def pipeline_metrics(documents: DataFrame) -> DataFrame:
    """Processed documents (status, pages, ms) -> one row: documents, those that failed, pages, mean time a page, pages a second."""
    g = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("status") != "failed", F.col("pages"))), F.lit(0)).alias("pages"), (F.coalesce(F.sum(units(F.col("ms"), 3)), F.lit(0)) / 1000).alias("total_ms"))
    per = F.when(F.col("pages") > 0, F.round(F.col("total_ms") / F.col("pages"), 4)).otherwise(0.0)
    return g.withColumn("ms_per_page", per).withColumn("pages_per_sec", F.when(F.col("total_ms") > 0, F.round(F.col("pages") / (F.col("total_ms") / 1000), 2)).otherwise(0.0))


def accuracy_rows(cases: DataFrame, texts: DataFrame, tables: DataFrame, layouts: DataFrame) -> DataFrame:
    """case_id, success of every case, with what is known of it: texts (case_id, ref, hyp), tables (case_id, nth, similarity;
    the first counts), layouts (case_id, gt, pred) -> cer, wer, table, layout_map, first_iou; null where there is no ground truth or
    the case failed."""
    cer = character_error_rate(normalized_text(F.col("ref")), normalized_text(F.col("hyp")), text_distance)
    wer = word_error_rate(normalized_text(F.col("ref")), normalized_text(F.col("hyp")))
    t = texts.where("ref is not null and hyp is not null").select("case_id", cer.alias("cer"), wer.alias("wer"))
    first = tables.groupBy("case_id").agg(F.min_by("similarity", "nth").alias("table"))
    m = mean_precision(layout_scores(layouts, (0.5, 0.6, 0.7, 0.8, 0.9))).select("case_id", F.col("map").alias("layout_map"))
    side = lambda c: tuple(F.get(F.get(c, F.lit(0))["box"], F.lit(i)) for i in range(4))
    one = layouts.select("case_id", iou(side(F.col("pred")), side(F.col("gt"))).alias("first_iou"))
    ok = cases.where("success").select("case_id")
    out = cases.join(ok.join(t, "case_id", "left").join(first, "case_id", "left").join(m, "case_id", "left").join(one, "case_id", "left"), "case_id", "left")
    return out.select("case_id", "success", "cer", "wer", "table", "layout_map", "first_iou")


def compared(results: DataFrame, case: str, adapter: str, value: str, base: str, other: str) -> DataFrame:
    """One row a case: both adapters' values, their relative difference in per cent, and the verdict."""
    p = results.groupBy(case).pivot(adapter, [base, other]).agg(F.first(value))
    pct = F.when(F.col(base) != 0, F.round((F.col(other) - F.col(base)) * 100.0 / F.col(base), 2))
    return p.select(case, F.col(base).alias("base"), F.col(other).alias("other"), pct.alias("change_pct"), F.when(pct < -5, "better").when(pct > 5, "worse").otherwise("equal").alias("verdict"))


def within_limits(cer: Column, wer: Column, f1: Column) -> Column:
    return (cer <= LIMITS["cer"]) & (wer <= LIMITS["wer"]) & (f1 >= LIMITS["layout_f1"])
