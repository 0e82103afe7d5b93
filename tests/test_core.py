"""Rules of single operators on small cases whose results are known."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import scratch
from pagewright.functions import strings as S
from pagewright.functions.ranks import at_ranks
from pagewright.functions.running import following, running_count
from pagewright.operators import export, imaging, inspection, layout, metrics, registry, reports
from pagewright.functions.skew import split_join
from pagewright.functions.tables import once
from pagewright.operators.shred import Shape, columns_of, every_table, flat_table, learned, schema_of, shred
from pagewright.plans.nested import p3_found
from pagewright.sources import files, text
from pagewright.sources.detect import detect
from pagewright.streaming import ingest
from pagewright.streaming.jobs import step


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    "content, path, override, expected",
    [
        (b"%PDF-1.7", "x", None, ("pdf", 1.0, "magic_bytes")),
        (bytes.fromhex("89504E470D0A1A0A"), "x.txt", None, ("image", 1.0, "magic_bytes")),
        (b"PK\x03\x04", "a.docx", None, ("docx", 0.95, "magic_bytes")),
        (b"PK\x03\x04..ppt/", "none", None, ("pptx", 0.95, "magic_bytes")),
        (b"PK\x03\x04 plain", "a.zip", None, ("txt", 0.5, "content_heuristics")),
        (b"  <!DOCTYPE HTML>", "a.txt", None, ("html", 0.95, "magic_bytes")),
        (b"hello", "a.md", None, ("markdown", 0.85, "extension")),
        (b"hello", "a.pdf", None, ("txt", 0.5, "content_heuristics")),
        (b"# T\nx", "none", None, ("markdown", 0.75, "content_heuristics")),
        (b"#T", "none", None, ("txt", 0.5, "content_heuristics")),
        (b"a\x00b", "none", None, (None, None, None)),
        (b"", "a.md", None, (None, None, None)),
        (b"hello", "x", "md", ("markdown", 1.0, "explicit_override")),
        (b"hello", "x", "xyz", (None, None, None)),
    ],
)
def test_detect(spark, content, path, override, expected):
    df = spark.createDataFrame([(bytearray(content), path, override)], "content binary, path string, o string")
    r = df.select(detect(F.col("content"), F.col("path"), F.col("o")).alias("d")).first().d
    assert (r.format, r.confidence, r.method) == expected


def test_text_sources(spark):
    df = spark.createDataFrame([(1, " a \n\n b\r\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.block_id, r.text) for r in text.txt_blocks(df).orderBy("pos").collect()] == [("txt_b_0", "a"), ("txt_b_1", "b"), ("txt_b_2", "c")]
    md = spark.createDataFrame([(1, "#tag\n####### x\n- i\n* j\n1. k")], "doc_id long, text string")
    got = [(r.block_id, r.block_type, r.heading_level, r.text, r["items"]) for r in text.markdown_blocks(md).orderBy("pos").collect()]
    assert got == [("md_h_0", "heading", 1, "tag", None), ("md_h_1", "heading", 6, "x", None), ("md_l_2", "list", None, None, ["i"]), ("md_l_3", "list", None, None, ["j"]), ("md_p_4", "paragraph", None, "1. k", None)]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<H2>A<b>B</b></H2><p></p><p>c</p>", [("html_b_0", "heading", "AB"), ("html_b_2", "paragraph", "c")]),
        ('<p class="x">a</p>', [("html_b_0", "paragraph", "a")]),
        ("<p>a<p>b</p>", [("html_b_0", "paragraph", "ab")]),
        ('<script>var t="</p>";</script><p>x</p>', [("html_b_0", "paragraph", "x")]),
        ("<p>a &amp; b</p>", [("html_b_0", "paragraph", "a &amp; b")]),
    ],
)
def test_html(spark, html, expected):
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert [(r.block_id, r.block_type, r.text) for r in text.html_blocks(df).orderBy("pos").collect()] == expected


@pytest.mark.parametrize("rotation, expected", [(0, (0.1, 0.1, 0.5, 0.125)), (90, (0.875, 0.1, 0.9, 0.5)), (180, (0.5, 0.875, 0.9, 0.9)), (270, (0.1, 0.5, 0.125, 0.9)), (45, (0.1, 0.1, 0.5, 0.125))])
def test_rotation(spark, rotation, expected):
    b = G.from_pdf(*[F.lit(float(x)) for x in (60, 700, 300, 720, 600, 800)], F.lit(rotation))
    assert tuple(one(spark, *[x.alias(n) for x, n in zip(b, "ltrb", strict=True)])) == expected


def test_overlap(spark):
    box = lambda *x: tuple(F.lit(float(v)) for v in x)
    r = one(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), G.iou(box(1, 1, 3, 3), box(0, 0, 2, 2)).alias("b"), G.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("c"))
    assert (r.a, r.b, r.c) == (0.1429, 0.1429, 0.0)


def test_error_rates(spark):
    pairs = [("", "", 0.0), ("", "x", 1.0), ("abc", "axc", 0.3333)]
    df = spark.createDataFrame(pairs, "a string, b string, c double").select(metrics.character_error_rate(F.col("a"), F.col("b")).alias("x"), "c")
    assert all(r.x == r.c for r in df.collect())
    r = one(spark, metrics.word_error_rate(F.lit("a b c d"), F.lit("a x c")).alias("w"), metrics.word_error_rate(F.lit("über b"), F.lit("uber b")).alias("u"))
    assert (r.w, r.u) == (0.5, 0.5)


def test_greedy_scores():
    a, b = ("text", [0, 0, 1, 1]), ("text", [5, 5, 6, 6])
    assert metrics.greedy_scores([], [], 0.5) == (1.0, 1.0, 1.0)
    assert metrics.greedy_scores([a], [], 0.5) == (0.0, 0.0, 0.0)
    assert metrics.greedy_scores([a, b], [a, a], 0.5) == (0.5, 0.5, 0.5)
    assert metrics.greedy_scores([a], [("text", None)], 0.5, before=False) == (0.0, 0.0, 0.0)


def test_structure_scores(spark):
    kinds = lambda xs: spark.createDataFrame([(1, x) for x in xs], "case long, kind string")
    r = metrics.multiset_scores(kinds(["text", "text", "heading"]), kinds(["text", "heading", "table"]), "case", "kind").first()
    assert (r.precision, r.recall, r.f1) == (0.6667, 0.6667, 0.6667)


def test_ranks(spark):
    df = spark.createDataFrame([("a", x) for x in (4.0, 1.0, 3.0, 2.0)] + [("b", 7.0), ("b", None), ("c", None)], "k string, v double")
    got = {r.k: (r["median"], r.p95, r.p99) for r in metrics.latency(df, "k", "v").collect()}
    assert got == {"a": (3.0, 4.0, 4.0), "b": (7.0, 7.0, 7.0)}
    assert at_ranks(df.where("false"), "k", "v", {"m": lambda n: n - n}).count() == 0


def test_running_count(spark):
    df = spark.createDataFrame([(1, i, i % 3 == 0) for i in range(50)], "k long, i int, f boolean")
    got = {r.i: r.c for r in running_count(df, "k", F.floor(F.col("i") / 7), ["i"], F.col("f"), "c").collect()}
    assert got == {i: i // 3 + 1 for i in range(50)}


def test_following(spark):
    rows = [("a", i, None if i % 5 == 3 else str(i)) for i in range(23)] + [("b", 7, "x")]
    df = spark.createDataFrame([r for r in rows if r[0] == "b" or not 8 <= r[1] < 15], "k string, i int, v string")
    got = {(r.k, r.i): r.n for r in following(df, "k", F.floor(F.col("i") / 4), ["i"], "v", "n").collect()}
    kept = [r for r in rows if r[0] == "a" and not 8 <= r[1] < 15]
    assert got == {("b", 7): None} | {("a", x[1]): y[2] for x, y in zip(kept, kept[1:], strict=False)} | {("a", 22): None}


def test_content_types(spark):
    df = spark.createDataFrame([(49, 0), (50, 0), (19, 1), (20, 1)], "c int, i int")
    assert [r[0] for r in df.select(inspection.content_type(F.col("c"), F.col("i"))).collect()] == ["EMPTY", "DIGITAL_TEXT_ONLY", "SCANNED_IMAGE_ONLY", "HYBRID"]


@pytest.mark.parametrize(
    "words, top, bottom, expected",
    [
        ("3", 0.5, 0.95, ("PAGE_NUMBER", 0.95)), ("3", 0.5, 0.6, ("PAGE_NUMBER", 0.8)), ("any text", 0.05, 0.1, ("HEADER", 0.85)), ("Figure 1: System Overview", 0.5, 0.6, ("HEADING", 0.7)),
        ("Figure 1: results of the run", 0.5, 0.6, ("CAPTION", 0.95)), ("2.1 Background", 0.5, 0.6, ("HEADING", 0.85)), ("1. item", 0.5, 0.6, ("LIST", 0.9)), ("1. Item", 0.5, 0.6, ("HEADING", 0.7)), (" ", 0.5, 0.6, ("UNKNOWN", 0.0)), (None, 0.5, 0.6, ("UNKNOWN", 0.0)),
    ],
)
def test_classes(spark, words, top, bottom, expected):
    c = layout.semantic_class(F.lit(words).cast("string"), F.lit("text"), F.lit(top), F.lit(bottom), F.lit(True))
    assert tuple(one(spark, c.alias("c")).c) == expected


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, i, f"b{i}", "text", "x", *map(float, r)) for i, r in enumerate(rows)], "doc_id long, page_index int, pos int, block_id string, block_type string, text string, left double, top double, right double, bottom double")


def test_reading_order(spark):
    two = boxes(spark, [(0.1, 0.1, 0.45, 0.2), (0.55, 0.1, 0.9, 0.2), (0.1, 0.3, 0.45, 0.4), (0.55, 0.3, 0.9, 0.4)])
    assert [r.block_id for r in layout.reading_order(two).orderBy("sequence_index").collect()] == ["b0", "b2", "b1", "b3"]
    title = boxes(spark, [(0.05, 0.0, 0.95, 0.05), (0.1, 0.1, 0.45, 0.2), (0.55, 0.1, 0.9, 0.2)])
    assert [(r.block_id, r.column_index) for r in layout.reading_order(title).orderBy("sequence_index").collect()] == [("b0", 0), ("b1", 0), ("b2", 0)]


def test_edges(spark):
    got = {(r.from_id, r.to_id): (r.relation, r.distance) for r in layout.spatial_edges(boxes(spark, [(0, 0, 1, 0.2), (0, 0.5, 1, 0.7)])).collect()}
    assert got == {("b0", "b1"): ("BELOW", 0.3), ("b1", "b0"): ("ABOVE", 0.3)}


@pytest.mark.parametrize("gap, shift, first, blocks", [(12, 0, "text here", 1), (26, 0, "text here", 2), (12, 31, "text here", 2), (12, 0, "1 Introduction", 2)])
def test_merge(spark, gap, shift, first, blocks):
    rows = [(1, 0, 0, first, 60.0, 700.0, 300.0, 714.0), (1, 0, 1, "more", 60.0 + shift, 700.0 - gap - 14, 300.0, 700.0 - gap)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, seq int, text string, left double, bottom double, right double, top double")
    assert layout.merged_lines(df).count() == blocks


def test_secrets_and_names(spark):
    masked = lambda s: one(spark, S.mask_secrets(F.lit(s)).alias("m")).m
    assert masked("token abc") == masked("risk-free") == S.REDACTED and masked("plain") == "plain"
    assert one(spark, S.mask_map(F.create_map(F.lit("monkey"), F.lit("x"))).alias("m")).m == {"monkey": S.REDACTED}
    assert one(spark, S.safe_file_name(F.lit("../../a b$.pdf")).alias("a"), S.safe_file_name(F.lit("///")).alias("b")) == ("ab.pdf", "uploaded_document")


def test_table_markdown(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "a", 1, 1), (1, 0, 0, 1, "b", 1, 1), (1, 1, 1, 2, "c", 1, 1)], "table_id long, row_index int, col_index int, pos int, text string, row_span int, col_span int")
    assert export.table_markdown(cells).first().body == "| b |  |\n| --- | --- |\n|  | c |"
    assert export.table_markdown(cells.withColumn("row_span", F.lit(2))).first().body.startswith("<table>")


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\nx")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "sub" / "b.docx").write_bytes(export.docx([("heading", "Head & co", 2), ("paragraph", "body", 0)]))
    (tmp_path / "sub" / "broken.docx").write_bytes(b"PK\x03\x04 word/ broken")
    scanned = files.scan(spark, str(tmp_path)).withColumn("doc_id", S.stem(F.col("path")))
    assert {r.doc_id: r.format for r in scanned.collect()} == {"a": "markdown", "b": "docx", "broken": "docx"}
    got = {(r.doc_id, r.block_type, r.text, r.heading_level) for r in files.blocks(scanned).collect()}
    assert got == {("a", "heading", "T", 1), ("a", "paragraph", "x", None), ("b", "heading", "Head & co", 2), ("b", "paragraph", "body", None)}


def test_epub():
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(export.epub("t", "<p>x</p>")))
    first = z.infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED


def test_remote_ocr(spark):
    rows = [(1, json.dumps({"regions": [{"text": "a", "confidence": 3, "bbox": [0, 0, 0.5, 1]}, {"text": "b"}]})), (2, '{"full_text": "t"}'), (3, "broken"), (4, None), (5, "[]")]
    got = files.remote_ocr(spark.createDataFrame(rows, "request_id long, body string")).orderBy("request_id", "pos").collect()
    assert [(r.request_id, r.text, r.confidence, r.bbox) for r in got] == [(1, "a", 1.0, [0, 0, 0.5, 1]), (1, "b", 1.0, [0, 0, 1, 1]), (2, "t", 1.0, [0, 0, 1, 1])]


def test_word_rows(spark):
    df = spark.createDataFrame([(1, 1, "b", 80.0), (1, 0, "a", 90.0), (1, 2, " ", 99.0), (1, 3, "x", -1.0)], "page_id long, pos int, text string, conf double")
    assert tuple(files.word_rows(df).first()) == (1, "a b", 0.85)


def test_images(spark):
    import numpy as np

    flat = [200.0] * 64
    df = spark.createDataFrame([(1, 8, flat, ["denoise", "nothing", "crop"])], "image_id long, width int, pixels array<double>, steps array<string>")
    r = imaging.measured(df).first()
    assert (r.mean, r["std"], r.blur, r.noise, r.skew) == (200.0, 0.0, 0.0, 0.0, 0.0)
    assert imaging.processed(df).first().applied == ["denoise", "crop"]
    assert imaging.tensor(np.zeros((4, 4)), 8).shape == (1, 3, 8, 8)
    assert imaging.cropped(np.zeros((10, 10)), (0.2, 0.1, 0.5, 0.3)).shape == (2, 3)


def test_registry(spark):
    r = registry.Registry()
    up = lambda: lambda pdf: pdf.assign(text=pdf.text.str.upper())
    r.register(registry.Provider("far", "ocr", "text string", up, remote=True))
    r.register(registry.Provider("off", "ocr", "text string", up, available=False))
    r.register(registry.Provider("on", "ocr", "text string", up))
    assert r.choose("ocr").name == "on" and r.choose("ocr", "off").name == "off" and r.choose("ocr", allow_remote=True).name == "far"
    with pytest.raises(LookupError):
        r.choose("table")
    assert registry.applied(spark.createDataFrame([("a",)], "text string"), r.choose("ocr")).first().text == "A"


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ok"), (2, "oversized"), (3, "ok")], "doc_id long, status string")
    blocks = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_index int")
    got = reports.process_results(blocks, docs)
    assert {(r.doc_id, r.status, r.error, r.blocks, r.pages) for r in got.collect()} == {(1, "completed", None, 2, 2), (2, "failed", "oversized", 0, 0), (3, "failed", "no content", 0, 0)}
    with pytest.raises(RuntimeError):
        reports.raise_on_failure(got)
    lines = [r.text for r in reports.markdown_report(got, ["doc_id", "status"], ["doc_id"]).collect()]
    assert lines == ["| doc_id | status |", "| --- | --- |", "| 1 | completed |", "| 2 | failed |", "| 3 | failed |"]
    bodies = spark.createDataFrame([(1, -1, "x"), (1, 0, "z")], "doc_id long, part int, body string")
    path = "file://" + str(tmp_path / "out")
    assert {tuple(r) for r in reports.write_documents(bodies, path).collect()} == {("1.md", True), ("1-0.md", True)}
    more = bodies.withColumn("body", F.lit("y")).union(spark.createDataFrame([(2, -1, "new")], bodies.schema))
    assert {tuple(r) for r in reports.write_documents(more, path).collect()} == {("1.md", False), ("1-0.md", False), ("2.md", True)}
    assert (tmp_path / "out" / "1.md").read_text() == "x" and (tmp_path / "out" / "2.md").read_text() == "new"
    reports.write_documents(more, path, overwrite=True).collect()
    assert (tmp_path / "out" / "1.md").read_text() == "y" and len(list((tmp_path / "out").iterdir())) == 3
    reports.write_table(bodies.withColumn("case_id", F.lit("c")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(reports.COLUMNS)


def test_polygon_and_labels(spark):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 4.0), (3.0, 2.0), (2.0, 5.0))])
    assert tuple(one(spark, *[c.alias(n) for c, n in zip(G.polygon_box(pts), "ltrb", strict=True)])) == (1.0, 2.0, 3.0, 5.0)
    r = one(spark, layout.label_category(F.lit(" Section_header ")).alias("a"), layout.label_category(F.lit(9)).alias("b"), layout.label_category(F.lit("x")).alias("c"))
    assert tuple(r) == ("TITLE", "PARAGRAPH", "UNKNOWN")
    numbers = [one(spark, layout.label_category(F.lit(i)).alias("c")).c for i in range(12)]
    assert numbers == ["CAPTION", "FOOTER", "FORMULA", "LIST", "FOOTER", "HEADER", "FIGURE", "TITLE", "TABLE", "PARAGRAPH", "TITLE", "UNKNOWN"]
    assert one(spark, layout.label_category(F.lit("list_item")).alias("c")).c == "LIST" and one(spark, layout.label_category(F.lit("footnote")).alias("c")).c == "FOOTER"


def test_jobs_stream(spark, tmp_path):
    assert step(None, "QUEUED") == "QUEUED" and step("COMPLETED", "RUNNING") == "COMPLETED" and step("QUEUED", "CANCELLED") == "CANCELLED"
    from pagewright.streaming.jobs import job_states

    rows = [("a", 1, "QUEUED"), ("a", 2, "RUNNING"), ("b", 1, "QUEUED"), ("a", 3, "FAILED"), ("a", 4, "RUNNING")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "job_id string, at int, status string").write.json(src)
    stream = spark.readStream.schema("job_id string, at int, status string").json(src)
    q = job_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.job_id, r.status, r.events) for r in spark.table("states").collect()} == {("a", "FAILED", 4), ("b", "QUEUED", 1)}


def test_documents_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# x")
    q = ingest.documents(spark, str(tmp_path / "in")).drop("content").writeStream.format("memory").queryName("docs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.doc_id, r.format) for r in spark.table("docs").collect()] == [("a", "markdown")]


# Rules whose order or values matter


def test_scanned_documents_are_deep(spark):
    """The kind of a document comes before its average."""
    pages = spark.createDataFrame([(1, 0, 0.8, False, False, False), (2, 0, 0.8, False, False, False), (3, 0, 0.1, False, False, False), (4, 0, 0.2, False, True, True)], "doc_id long, page_index int, complexity double, has_tables boolean, has_figures boolean, has_formulas boolean")
    category = spark.createDataFrame([(1, "SCANNED"), (2, "HYBRID"), (3, "DIGITALLY_GENERATED"), (4, "HYBRID")], "doc_id long, category string")
    got = {r.doc_id: (r.kind, r.path) for r in inspection.document_routing(pages, category).collect()}
    assert got == {1: ("scanned_document", "deep_ml"), 2: ("digital_pdf", "vlm_fallback"), 3: ("digital_pdf", "fast_path"), 4: ("technical_report", "deep_ml")}


def test_native_text_is_of_pdf(spark):
    df = spark.createDataFrame([("pdf", 0.9, 0.0), ("other", 0.9, 0.0), ("pdf", 0.7, 0.0)], "format string, ratio double, scan_prob double")
    df = df.withColumns({"image_density": F.lit(0.0), "has_tables": F.lit(False), "has_figures": F.lit(False), "has_formulas": F.lit(True)})
    assert [r.s for r in df.select(inspection.capabilities().alias("s")).collect()] == [["native_pdf", "formula"], ["ocr", "formula"], ["ocr", "formula"]]


def test_provider_chains(spark):
    known = spark.createDataFrame([("ocr.rapidocr", False, False), ("ocr.tesseract", False, True), ("ocr.remote", True, True), ("vlm.openai", True, False)], "provider_id string, remote boolean, available boolean")
    schema = "request_id long, capability string, policy string, page_override string, override string, priority array<string>"
    requests = [(1, "ocr", "local_only", None, None, None), (2, "ocr", "local_only", None, "ocr.remote", None), (3, "ocr", "remote_only", "ocr.rapidocr", "nothing", None), (4, "vlm", "local_only", None, None, ["vlm.openai"]), (5, "figure", "local_preferred", None, None, [])]
    got = {}
    for r in inspection.choose_provider(spark.createDataFrame(requests, schema), known).orderBy("request_id", "attempt").collect():
        got.setdefault(r.request_id, []).append((r.provider_id, r.result, r.why))
    assert got == {
        1: [("ocr.rapidocr", "FAILED", "health"), ("ocr.surya", "FAILED", "not registered"), ("ocr.tesseract", "SELECTED", "chain")],
        2: [("ocr.remote", "SKIPPED", "policy"), ("ocr.rapidocr", "FAILED", "health"), ("ocr.surya", "FAILED", "not registered"), ("ocr.tesseract", "SELECTED", "chain")],
        3: [("ocr.rapidocr", "SELECTED", "override")],
        4: [("vlm.openai", "SKIPPED", "policy")],
        5: [("figure.local", "FAILED", "not registered")],
    }


@pytest.mark.parametrize("words, box, expected", [("3", False, "PARAGRAPH"), ("Methodology", True, "HEADING"), ("acknowledgment", True, "HEADING"), ("figure 2: the parts", True, "CAPTION"), ("IV. Results", True, "HEADING"), ("+ one", True, "LIST")])
def test_more_classes(spark, words, box, expected):
    c = layout.semantic_class(F.lit(words), F.lit("text"), F.lit(0.5), F.lit(0.6), F.lit(box))
    assert one(spark, c.alias("c")).c.category == expected


def test_captions_and_sections_by_class(spark):
    rows = [(1, 0, 0, "f", "figure", None, 0.1, 0.3, 0.9, 0.5), (1, 0, 1, "t", "text", "Figure 1: System Overview", 0.1, 0.55, 0.9, 0.6), (1, 0, 2, "c", "text", "figure 1: what the system does", 0.1, 0.65, 0.9, 0.7)]
    b = spark.createDataFrame(rows, "doc_id long, page_index int, pos int, block_id string, block_type string, text string, left double, top double, right double, bottom double")
    b = b.withColumn("c", layout.semantic_class(F.col("text"), F.col("block_type"), F.col("top"), F.col("bottom"), F.lit(True)))
    (r,) = layout.assigned_captions(layout.spatial_edges(b), b, F.col("c.category") == "CAPTION").collect()
    assert (r.block_id, r.caption) == ("f", "figure 1: what the system does")
    s = {x.section_id: (x.title, x.level, x.blocks) for x in layout.sections(b, F.col("c.category") == "HEADING", F.lit(2)).collect()}
    assert s == {"sec_root": ("Document Body", 1, "f"), "sec_t": ("Figure 1: System Overview", 2, "c")}


def test_pdf_parts(spark):
    chars = spark.createDataFrame([(1, 0, 0, 5.0, 5.0, 9.0, 9.0), (1, 0, 0, 2.0, 6.0, 4.0, 12.0), (1, 0, 0, 0.0, 0.0, 0.0, 0.0), (1, 0, 1, 3.0, 3.0, 3.0, 3.0)], "doc_id long, page_index int, seq int, left double, bottom double, right double, top double")
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page_index int, width double, height double")
    got = {r.seq: (r.left, r.bottom, r.right, r.top) for r in layout.line_boxes(chars, pages).collect()}
    assert got == {0: (2.0, 5.0, 9.0, 12.0), 1: (0.0, 0.0, 600.0, 800.0)}
    b = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, "c")], "doc_id long, page_index int, block int, text string")
    im = spark.createDataFrame([(1, 0, 0), (1, 3, 0)], "doc_id long, page_index int, image_index int")
    got = [(r.block_id, r.reading_order_index) for r in layout.assembled(b, im).orderBy("reading_order_index").collect()]
    assert got == [("p0-b0", 0), ("p0-b1", 1), ("p0-fig0", 2), ("p2-b0", 3), ("p3-fig0", 4)]


EXPORTED = "doc_id long, page_index int, pos int, block_id string, block_type string, text string, heading_level int, ordered boolean, list_items array<struct<text:string,marker:string,reading_order_index:int>>, provenance struct<provider:string,stage:string>, caption string, image binary, cells array<struct<row_index:int,col_index:int,row_span:int,col_span:int,text:string>>"


def exported(spark):
    cells = [(0, 0, 1, 1, "old"), (0, 0, 1, 1, "A"), (0, 1, 1, 1, "B"), (1, 1, 1, 1, "d")]
    rows = [
        (1, 0, 0, "h", "heading", "Head", 9, None, None, ("p", "OCR"), None, None, None), (1, 0, 1, "l", "list", None, None, True, [("x", "", 0), ("y", "", 1)], None, None, None, None), (1, 0, 2, "t", "table", None, None, None, None, None, None, None, cells),
        (1, 0, 3, "m", "table", None, None, None, None, None, None, None, [(0, 0, 1, 2, "wide")]), (1, 0, 4, "f", "figure", None, None, None, None, None, "Cap", b"img", None), (1, 0, 5, "e", "formula", "x=1", None, None, None, None, None, None, None), (1, 0, 6, "c", "caption", "Under", None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, EXPORTED)


def test_exports(spark):
    b = exported(spark)
    files = spark.createDataFrame([(1, "n.pdf", "T", "Me", "2024")], "doc_id long, doc_name string, title string, author string, created_at string")
    md = {r.part: r.body for r in export.markdown_parts(b, files).collect()}
    assert md[-1] == "# n.pdf\n**Author:** Me\n**Date:** 2024\n"
    assert md[0] == (
        "<!-- provenance: provider=p stage=OCR -->\n###### Head\n\n1. x\n1. y\n\n| A | B |\n| --- | --- |\n|  | d |\n\n<table>\n  <tbody>\n    <tr>\n      <td>wide</td>\n    </tr>\n  </tbody>\n</table>\n\n"
        "![f](data:image/png;base64,aW1n)\n*Cap*\n\n$$\nx=1\n$$\n\nUnder\n"
    )
    txt = {r.part: r.body for r in export.text_parts(b, files).collect()}
    assert txt[0] == "--- Page 1 ---\nHEAD\n\n- x\n- y\n\nA | B\n | d\n\nwide\n\n[Figure: f]\nCaption: Cap\n\nEquation: x=1\n\nUnder\n"
    html = export.document_of(export.html_parts(b, files)).first().body.split("\n")
    assert html[0] == "<!DOCTYPE html>" and html[-1] == "</html>" and '      <h6 data-provider="p" data-stage="OCR">Head</h6>' in html and "            <td>d</td>" in html and "        <figcaption>Cap</figcaption>" in html and "      <div>Under</div>" in html
    assert {(r.block_id, r.warning[:5]) for r in export.warnings_of(b).collect()} == {("m", "Table"), ("f", "Raste")}
    whole = export.document_of(export.archival_parts(export.html_parts(b, files), files)).first().body
    assert whole.startswith('<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8">\n  <meta name="pdfa') and whole.endswith("</html></body>\n</html>") and "<title>T</title>" in whole


def test_binary_exports(spark):
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(bytes(export.docx_documents(exported(spark)).first().content)))
    doc = z.read("word/document.xml").decode()
    assert z.read("word/media/image1.png") == b"img" and "<w:tbl>" in doc and "Caption: Cap" in doc and "Equation: x=1" in doc and 'w:val="Heading4"' in doc and "ListNumber" in doc
    files = spark.createDataFrame([(1, "n.pdf", "T", None, None)], "doc_id long, doc_name string, title string, author string, created_at string")
    z = zipfile.ZipFile(io.BytesIO(bytes(export.epub_documents(export.html_parts(exported(spark), files), files).first().content)))
    assert z.namelist()[0] == "mimetype" and "<figcaption>Cap" in z.read("OEBPS/chapter1.xhtml").decode() and "<dc:title>T</dc:title>" in z.read("OEBPS/content.opf").decode()


def test_chunks(spark):
    rows = [(1, p, i, f"b{p}{i}", k, t, lv) for p, i, k, t, lv in ((0, 0, "heading", " One ", 1), (0, 1, "text", "a", None), (0, 2, "heading", " ", 2), (450, 0, "heading", "Two", 2), (450, 1, "text", "b", None), (450, 2, "text", " ", None))]
    b = spark.createDataFrame(rows, "doc_id long, page_index int, pos int, block_id string, block_type string, text string, heading_level int").withColumn("bbox", F.struct(*[F.lit(0.123456).alias(f"box_{x}") for x in ("left", "top", "right", "bottom")]))
    c = export.with_hierarchy(export.rag_chunks(b), export.heading_list(b)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text, r.heading_hierarchy) for r in c] == [("1_p0_bb00", "One", ["One"]), ("1_p0_bb01", "a", ["One"]), ("1_p450_bb4500", "Two", ["One", "", "Two"]), ("1_p450_bb4501", "b", ["One", "", "Two"])]
    assert c[0].bbox == [0.1235] * 4
    chunks = spark.createDataFrame([("i", 1, "n", 0, "text", "t")], "chunk_id string, doc_id long, document_name string, page_index int, chunk_type string, text string")
    r = json.loads(chunks.select(export.vector_record("llamaindex", chunks).alias("r")).first().r)
    assert r["id_"] == "i" and r["extra_info"]["document_name"] == "n" and r["extra_info"]["table_matrix"] is None
    t = export.rag_chunks(exported(spark)).where("chunk_type = 'table'").orderBy("chunk_id").collect()
    assert t[1].table_matrix == [["A", "B"], ["", "d"]] and t[1].text == "A | B\n | d"


def test_png_crops_and_lanczos(spark):
    import struct
    import zlib

    page = [float(10 * y + x) for y in range(10) for x in range(8)]
    pages = spark.createDataFrame([(1, 0, 8, page), (1, 1, 8, page)], "doc_id long, page_index int, width int, pixels array<double>")
    box = "doc_id long, page_index int, region_idx int, category string, left double, top double, right double, bottom double"
    (r,) = imaging.figure_crops(pages, spark.createDataFrame([(1, 0, 4, "FIGURE", 0.25, 0.5, 0.75, 0.8), (1, 0, 5, "TABLE", 0.0, 0.0, 1.0, 1.0), (1, 9, 6, "FIGURE", 0.0, 0.0, 1.0, 1.0)], box)).collect()
    content = bytes(r.content)
    assert (r.block_id, r.width, r.height) == ("fig_ml_0_4", 4, 3) and content.startswith(b"\x89PNG\r\n\x1a\n") and struct.unpack(">II", content[16:24]) == (4, 3)
    n = struct.unpack(">I", content[33:37])[0]
    assert zlib.decompress(content[41 : 41 + n]) == b"".join(bytes([0, *(10 * y + x for x in range(2, 6))]) for y in range(5, 8))
    w = imaging._lanczos(8, 20)
    assert w.shape == (20, 8) and abs(w.sum(1) - 1).max() < 1e-12 and (imaging._resized(np.full((3, 4), 7.0), 12) == 7).all()
    assert bytes(imaging.as_png(pages.select(F.lit(1).cast("long").alias("image_id"), "width", "pixels")).first().content)[:4] == b"\x89PNG"


def test_sample_cases(spark):
    rows = files.sample_cases(spark).collect()
    assert [r.case_id for r in rows] == ["ci_digital_doc", "ci_scanned_doc"] and [e.bbox for e in rows[0].elements] == [[0.1, 0.1, 0.9, 0.2], [0.1, 0.25, 0.9, 0.5]]


def test_model_store(spark, tmp_path):
    m = registry.models(spark)
    assert m.count() == 10 and registry.of_task(m, "layout").count() == 2
    path = str(tmp_path / "store")
    registry.write_store(registry.with_state(registry.without(m, "tesseract"), "easyocr", "disabled"), path)
    back = {r.model_id: (r.state, r.checksum_sha256) for r in registry.read_store(spark, path).collect()}
    assert len(back) == 9 and back["easyocr"] == ("disabled", None) and back["slanet_table"][1].startswith("a665")
    more = spark.createDataFrame([("easyocr", "x", "other"), ("new", "y", "ocr")], "model_id string, provider string, task string")
    assert registry.registered(m, more).count() == 11
    assert registry.made({"p": registry.Provider}, "p", {"name": "n", "task": "ocr", "schema": "a int", "make": None}).name == "n"
    with pytest.raises(LookupError):
        registry.made({}, "p", {})


def test_batch_and_stream_agree_on_states(spark):
    from pagewright.streaming.ingest import STATES, in_order, latest_states

    rnd = random.Random(3)
    events = [(j, i, i, rnd.choice(STATES[: rnd.randint(2, 5)])) for j in range(60) for i in range(rnd.randint(1, 5))]
    want = {}
    for j, _, _, s in events:
        want[j] = step(want.get(j), s)
    df = latest_states(spark.createDataFrame(events, "job_id long, at int, seq int, status string"))
    assert {r.job_id: r.status for r in df.collect()} == want
    assert [r.job_id for r in in_order(df, "job_id")] == sorted(want)


def test_listing(spark):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("a", "zeta.pdf", False, day(1)), ("b", "Alpha.pdf", False, day(3)), ("c", "sub", True, day(2)), ("d", ".hidden.pdf", False, day(4)), ("e", "beta.txt", False, day(5)), ("f", "alpha.md", False, day(6))]
    f = spark.createDataFrame(rows, "path string, name string, is_dir boolean, modified timestamp")
    shown = lambda d: [r.name for r in d.orderBy("place").collect()]
    assert shown(reports.listing(f)) == ["sub", "alpha.md", "Alpha.pdf", "beta.txt", "zeta.pdf"]
    assert shown(reports.listing(f, "a", [".pdf"])) == ["Alpha.pdf", "zeta.pdf"] and shown(reports.listing(f, by="time"))[:2] == ["sub", "alpha.md"]
    assert reports.matching(f, ["name"], "ALPHA").count() == 2 and reports.matching(f, ["name"], "").count() == 6


def test_performance(spark):
    rows = [("a", 1, 4.0, True), ("a", 2, 1.0, True), ("a", 3, 2.0, True), ("a", 4, 3.0, True), ("a", 5, 9.0, False), ("b", 1, 0.0001, False)]
    r = {x.case: x for x in metrics.performance(spark.createDataFrame(rows, "case string, at int, s double, ok boolean"), "case", "s", ["at"], F.col("ok"), F.lit(2)).collect()}
    a, b = r["a"], r["b"]
    assert (a.runs, a.total_sec, a.cold_start_sec, a.mean_sec, a.median_sec, a.p95_sec, a.docs_per_sec, a.pages_per_sec) == (4, 10.0, 4.0, 2.5, 3.0, 4.0, 0.4, 0.8)
    assert b.runs == 1 and b.docs_per_sec == 1000.0
    one_out = spark.createDataFrame([("x", float(v)) for v in [*range(1000), 10**15]], "k string, v double")
    assert metrics.latency(one_out, "k", "v").first()[1:] == (1001, 500.0, 950.0, 990.0)


def test_accuracy_rows(spark):
    box = "array<struct<type:string,box:array<double>>>"
    cases = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "case_id string, success boolean")
    texts = spark.createDataFrame([("a", "abc", "axc"), ("b", "x", "x")], "case_id string, ref string, hyp string")
    tables = spark.createDataFrame([("a", 2, 0.1), ("a", 1, 0.7)], "case_id string, nth int, similarity double")
    lay = spark.createDataFrame([("a", [("t", [0.0, 0.0, 2.0, 2.0])], [("t", [1.0, 1.0, 3.0, 3.0])])], f"case_id string, gt {box}, pred {box}")
    got = {r.case_id: tuple(r)[2:] for r in metrics.accuracy_rows(cases, texts, tables, lay).collect()}
    assert got == {"a": (0.3333, 1.0, 0.7, 0.0, 0.1429), "b": (None,) * 5, "c": (None,) * 5}
    assert tuple(one(spark, metrics.html_similarity(F.lit("<t>"), F.lit("<t>")).alias("a"), metrics.html_similarity(F.lit("<t>"), F.lit("<u>")).alias("b"))) == (1.0, 0.5)


# Nested records

REPEATED = ("pages", "blocks", "children", "items", "cells")


def shredded(spark, payloads, columns="rec_id long, payload string"):
    df = spark.createDataFrame(payloads, columns)
    return shred(df, "pages", REPEATED)


def test_shred_levels():
    record = '{"pages": [{"blocks": [{"id": "a", "items": [{"text": "x"}, {"text": "y"}]}, {"id": "b"}]}, {}]}'
    shape = learned([record, '{"pages": [{"blocks": [{"caption": "c"}]}]}'], "pages", frozenset(REPEATED))
    groups = {g.path: g for g in columns_of(record, "pages", shape)}
    items = groups["pages.blocks.items"]
    assert list(zip(items.rep, items.leaves["text"][0], items.leaves["text"][1], strict=True)) == [(0, 4, "x"), (3, 4, "y"), (2, 2, None), (1, 1, None)]
    assert groups["pages.blocks"].leaves["caption"] == ([2, 2, 1], [None] * 3)  # a column of another record
    assert Shape.of_rows(shape.rows()) == shape


def walked(rec, payload):
    """p3_found of one record whose fields are spelt plainly, by walking it."""
    out = set()
    listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]

    def block(x, page, parent):
        if x is None:
            return
        out.add((rec, page, x.get("id"), parent, -1))
        for name in ("items", "cells"):
            out.update((rec, page, x.get("id"), parent, i) for i, y in enumerate(listed(x.get(name))) if y is not None)
        for y in listed(x.get("children")):
            block(y, page, x.get("id"))

    for i, p in enumerate(listed(payload["pages"])):
        if p is not None:
            for x in listed(p.get("blocks")):
                block(x, p.get("page_index", i), "")
    return out


def test_shred_against_a_walk(spark, tmp_path):
    rnd = random.Random(5)
    ids = itertools.count()
    some = lambda xs: rnd.choice([xs, xs, xs, xs[0] if xs else None, None])

    def block(depth):
        b = {"id": f"b{next(ids)}"}
        for name in ("items", "cells"):
            if rnd.random() < 0.5:
                b[name] = some([rnd.choice([None, {"text": "t"}, "plain"]) for _ in range(rnd.randint(0, 3))])
        if depth < 5 and rnd.random() < 0.5:
            b["children"] = some([block(depth + 1) for _ in range(rnd.randint(0, 3))])
        return b

    docs = [{"pages": some([{"blocks": some([block(0) for _ in range(rnd.randint(0, 3))])} | ({"page_index": rnd.randint(0, 9)} if rnd.random() < 0.5 else {}) for _ in range(rnd.randint(0, 4))])} for _ in range(120)]
    spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "rec_id long, payload string").write.parquet(str(tmp_path / "doc_records.parquet"))
    got = [tuple(r) for r in p3_found(spark, str(tmp_path)).collect()]
    want = set().union(*(walked(i, d) for i, d in enumerate(docs)))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_shred_cases(spark):
    payloads = [
        (1, '{"pages": {"blocks": {"id": 7, "children": {"id": "c", "items": [null, {"text": "t"}]}}}}'),
        (1, '{"pages": {"blocks": {"id": 7, "children": {"id": "c", "items": [null, {"text": "t"}]}}}}'),
        (2, None), (3, ""), (4, '{"pages": [{"blo'), (5, '{"pages": null}'), (6, "[]"), (7, "null"),
        (8, json.dumps(json.dumps({"Pages": [{"Blocks": [{"ID": "z"}]}]}))), (9, '{"status": 1, "result": {"pages": [{"blocks": [null, {"id": "w"}]}]}}'),
    ]
    n = shredded(spark, payloads)
    blocks = {(r.rec_id, r.path, r.place, r.block_id) for r in flat_table(n, ["blocks", "children"], {"id": "block_id"}).collect()}
    assert blocks == {(1, "pages.blocks", 0, "7"), (1, "pages.blocks.children", 0, "c"), (8, "pages.blocks", 0, "z"), (9, "pages.blocks", 1, "w")}
    items = [(r.rec_id, r.place, r.t) for r in flat_table(n, ["items"], {"text": "t"}).collect()]
    assert items == [(1, 1, "t")]


def test_shred_empty_and_clashing(spark):
    assert shredded(spark, []).count() == 0
    rows = [(1, '{"pages": [{"blocks": [{"id": "a"}]}]}', "x", 5)]
    assert flat_table(shredded(spark, rows, "rec_id long, payload string, path string, n int"), ["blocks"], {"id": "i"}).first().i == "a"


def test_shred_deep_and_long(spark):
    deep = '{"id": "x"}'
    for i in range(20_000):
        deep = '{"id": "%d", "children": [%s]}' % (i, deep)
    record = '{"a": {"b": {"c": {"d": {"e": {"pages": [{"blocks": [%s]}]}}}}}}' % deep
    for _ in range(4):
        record = record if len(record) > 2_000_000 else json.dumps(record)
    got = flat_table(shredded(spark, [(1, record), (2, '{"pages": [{"blocks": [{"id": "y"}]}]}')]), ["blocks", "children"], {"id": "i"})
    assert got.groupBy("rec_id").count().orderBy("rec_id").collect()[0]["count"] == 20_001 and got.where("top_n != 1").count() == 0
    long = json.dumps({"pages": [{"blocks": [{"id": "a", "text": "y" * 2_000_000}]}]})
    assert len(flat_table(shredded(spark, [(1, long)]), ["blocks"], {"text": "t"}).first().t) == 2_000_000


def test_shred_every_table(spark):
    rows = [(1, '{"Metadata": {"id": "m", "n": 1.5}, "pages": [{"blocks": [{"id": "a", "bbox": [1, 2]}]}]}'), (2, '{"pages": [{"blocks": {"id": "b", "bbox": {"left": 3}}}]}')]
    got = {(r.rec_id, r.path, r.place, tuple(sorted((k, v) for k, v in r.fields.items() if v is not None))) for r in every_table(shredded(spark, rows)).collect()}
    assert got == {
        (1, "", 0, (("metadata.id", "m"), ("metadata.n", "1.5"))), (1, "pages", 0, ()), (1, "pages.blocks", 0, (("id", "a"),)), (1, "pages.blocks.bbox", 0, (("value", "1"),)), (1, "pages.blocks.bbox", 1, (("value", "2"),)),
        (2, "", 0, ()), (2, "pages", 0, ()), (2, "pages.blocks", 0, (("id", "b"),)), (2, "pages.blocks.bbox", 0, (("left", "3"),)),
    }
    assert schema_of(spark.createDataFrame(rows, "rec_id long, payload string"), "pages", REPEATED).fields["pages"].fields["blocks"].fields["bbox"].scalar


# Keys that hold many rows


def test_split_join(spark):
    """Half of all rows have one key; no part of it holds more than its share."""
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (None, "d")], "k long, v string")
    for n in (100, 10**6):
        got = split_join(big, small, ["k"], ["id"], n)
        assert got.columns == ["k", "id", "v"] and got.count() == 4001
        parts = got.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
        assert n > 4000 or len(parts) > 1
    assert split_join(big.where("false"), small, ["k"], ["id"]).count() == 0


def test_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (3, None)], "k long, v string")
    assert sorted(tuple(r) for r in once(df, "k").collect()) == [(1, "a"), (2, "b"), (3, None)]


def test_scratch_needs_a_shared_folder():
    class Cluster:
        conf = {}  # noqa: RUF012
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a"})  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)
