"""Queries over small tables in which a part left out would show."""

import hashlib
from decimal import ROUND_HALF_UP, Decimal
from itertools import pairwise

import pytest

import __spark_entry__ as entry
from pagewright.operators import metrics

QUERIES = entry.queries()
BLOCK = "block_uid long, doc_id long, page_index int, pos int, block_id string, block_type string, text string, heading_level int, ordered boolean, list_items array<struct<text:string,marker:string,reading_order_index:int>>, provenance struct<provider:string,stage:string>, bbox struct<box_left:double,box_top:double,box_right:double,box_bottom:double,is_normalized:boolean>"


def block(uid, pos, kind, text, box=None, page=0):
    return (uid, 1, page, pos, f"b{uid}", kind, text, None, None, None, None, box)


@pytest.fixture
def run(spark, tmp_path):
    def result(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{t}.parquet"))
        return QUERIES[name](spark, str(tmp_path)).collect()

    return result


FILES = "doc_id long, doc_name string, title string, author string, created_at string"


def test_text_of_all_letters(run):
    blocks = [block(1, 0, "heading", "Straße"), block(2, 1, "paragraph", "naïve café"), block(3, 2, "paragraph", "plain"), block(4, 3, "caption", "図 1")]
    got = {r.part: (r.digest, r.n_chars) for r in run("export_text", blocks=(blocks, BLOCK), files=([(1, "f.pdf", None, None, None)], FILES))}
    head, page = "DOCUMENT: f.pdf\n" + "=" * 40 + "\n", "--- Page 1 ---\nSTRASSE\n\nnaïve café\n\nplain\n\n図 1\n"
    assert got == {-1: (hashlib.md5(head.encode()).hexdigest(), len(head)), 0: (hashlib.md5(page.encode()).hexdigest(), len(page))}


def test_whole_texts_of_cells(run):
    long = "A text of more than twenty characters, to its last word"
    blocks = [block(1, 0, "table", None, (0.0, 0.0, 1.0, 0.5, True)), block(2, 1, "text", long, (0.1, 0.1, 0.3, 0.2, True)), block(3, 2, "text", "second " + long, (0.1, 0.3, 0.3, 0.4, True))]
    pages = ([(1, 0, 600.0, 800.0, 0)], "doc_id long, page_index int, width double, height double, rotation int")
    got = {r.cell_id: r.text for r in run("cell_text", blocks=(blocks, BLOCK), raw_pages=pages)}
    assert got == {"c": f"{long} second {long}", "d": ""}


def test_table_of_every_order(run):
    lines = [(k, n, 10 * k + n, "N") for k in (1, 2, 3, 4) for n in (1, 2)]
    got = {r.table_id: r.body for r in run("table_markdown", lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string"))}
    assert got == {k: f"| {10 * k + 1} | N |\n| --- | --- |\n| {10 * k + 2} | N |" for k in (1, 2, 3, 4)}


def test_formats_by_the_whole_header(run):
    """A mark after 400 characters counts, one after 2,048 bytes doesn't; a letter cut at the header's end is no text."""
    docs = [(9, "a" * 500 + "\n# Title"), (10, "a" * 2047 + "é"), (11, "a" * 2048 + "\n# Title"), (12, "é" * 1024 + "\n# Title")]
    got = {r.doc_id: (r.format, r.confidence, r.error) for r in run("detect_format", documents=(docs, "doc_id long, text string"))}
    assert got == {9: ("markdown", 0.75, None), 10: (None, None, "unsupported"), 11: ("txt", 0.5, None), 12: ("txt", 0.5, None)}


@pytest.mark.parametrize("name", ["layout_scores", "layout_map", "layout_scores_by_score"])
def test_pages_of_boxes_in_points(run, name):
    blocks = [block(7, 0, "text", "a", (60.0, 720.0, 300.0, 640.0, False)), block(14, 0, "text", "b", (0.1, 0.1, 0.5, 0.2, True), 1), block(21, 0, "text", "c", (0.1, 0.1, 0.5, 0.2, None), 2)]
    pages = ([(1, i, 600.0, 800.0, 0) for i in range(3)], "doc_id long, page_index int, width double, height double, rotation int")
    got = run(name, blocks=(blocks, BLOCK), raw_pages=pages)
    assert {(r.case_id, r.map if name == "layout_map" else r.f1) for r in got} == {(f"1/{i}", 1.0) for i in range(3)}


def test_overlap_of_boxes_in_points(run):
    blocks = [block(3, 0, "text", "a", (60.0, 720.0, 300.0, 640.0, False)), block(10, 1, "text", "b", (0.1, 0.1, 0.5, 0.2, True)), block(17, 2, "text", "c", (0.1, 0.1, 0.5, 0.2, None))]
    pages = ([(1, 0, 600.0, 800.0, 0)], "doc_id long, page_index int, width double, height double, rotation int")
    # All are 100, 100, 500, 200 in thousandths, moved to 112, 97, 503, 206.
    assert {r.block_uid: r.iou for r in run("box_overlap", blocks=(blocks, BLOCK), raw_pages=pages)} == {u: round(388 * 100 / (400 * 100 + 391 * 109 - 388 * 100), 3) for u in (3, 10, 17)}


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


TEXTS = ["é è", "à\u00a0 ü", "Größe der 図 表", "größe  der 表", "a b c d e f", "a b c d x f", "", "Ünd " * 60, "und " * 55 + "図"]


def test_edits():
    for a in TEXTS:
        for b in TEXTS:
            assert metrics.edits(a, b) == slow_edits(a, b)
            assert metrics.edits(a.split(), b.split()) == slow_edits(a.split(), b.split())


def half_up(x, places):
    return float(Decimal(repr(x)).quantize(Decimal(10) ** -places, ROUND_HALF_UP))


def expected_rates(a, b):
    a, b = (" ".join(x.split()).lower() for x in (a, b))
    rate = lambda x, y: half_up(slow_edits(x, y) / len(x), 4) if x else float(bool(y))
    return rate(a, b), rate(a.split(), b.split())


def stored(texts):
    return [block(i, i, ("heading", "paragraph", "caption")[i % 3], x) for i, x in enumerate(texts)]


def test_rates_of_texts_as_stored(run):
    got = {r.block_uid: (r.cer, r.wer) for r in run("text_error_rates", blocks=(stored(TEXTS), BLOCK))}
    assert got == {i: expected_rates(*x) for i, x in enumerate(pairwise(TEXTS))}


def test_gate_of_texts_as_stored(run):
    got = {r.block_uid: r.passed for r in run("regression_gate", blocks=(stored(["né", "nè", "nè"]), BLOCK))}
    assert got == {0: False, 1: True}


def test_ngrams_of_texts_as_stored(run):
    got = {r.block_uid: r.bleu for r in run("ngram_scores", blocks=(stored(["né a b c d", "nè a b c d", "nè a b c d", "x"]), BLOCK))}
    assert got == {0: round((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25, 3), 1: 1.0, 2: 0.0}
