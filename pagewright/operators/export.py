"""Blocks written as text: Markdown, HTML, plain text, JSON, chunks for retrieval, and binary files.

Blocks come as doc_id, page_index, pos, block_id, block_type, text, heading_level, ordered, list_items and
provenance; further columns are used where they are there: caption, expression, image (bytes), num_rows,
num_cols and cells (an array of row_index, col_index, row_span, col_span, text). Each block is
rendered on its own as an array of lines. A page is put together from its blocks; a document is its parts in order
(head, pages, end), one row each, so that no task holds more than a page.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagewright.functions.running import running_count
from pagewright.functions.skew import split_join
from pagewright.functions.strings import strip

# Colours by kind of block, and of all others; the confidence an overlay states.
COLOURS = {"heading": "#ef4444", "title": "#ef4444", "table": "#10b981", "formula": "#8b5cf6", "figure": "#f59e0b"}
OTHER_COLOUR = "#3b82f6"
OVERLAY_CONFIDENCE = 0.95
#: Parts of a document: before its first page, and after its last.
HEAD, END = -1, 2**31 - 1
CELL = "array<struct<row_index:int,col_index:int,row_span:int,col_span:int,text:string>>"
MERGED_WARNING = "Table contains merged cells; rendered using embedded HTML table syntax fallback."


def _kind() -> Column:
    return F.lower("block_type")


class Parts:
    """What a block consists of, as columns; what isn't among the table's columns is null or empty."""

    def __init__(self, blocks: DataFrame) -> None:
        has = set(blocks.columns)
        get = lambda name, kind: (F.col(name) if name in has else F.lit(None)).cast(kind)
        self.kind = _kind()
        self.text = F.coalesce("text", F.lit(""))
        self.level = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(6), F.col("heading_level"))), F.lit(1))
        self.ordered = F.coalesce(get("ordered", "boolean"), F.lit(False))
        items = F.col("list_items") if "list_items" in has else F.array()
        self.items = F.transform(F.coalesce(items.cast("array<struct<text:string,marker:string,reading_order_index:int>>"), F.array().cast("array<struct<text:string,marker:string,reading_order_index:int>>")), lambda x: F.coalesce(x["text"], F.lit("")))
        self.caption = F.coalesce(get("caption", "string"), F.when(self.kind == "figure", F.col("text")))
        self.expression = F.coalesce(get("expression", "string"), self.text)
        self.image = get("image", "binary")
        self.provenance = F.col("provenance") if "provenance" in has else None
        cells = F.coalesce(get("cells", CELL), F.array().cast(CELL))
        rows = F.coalesce(get("num_rows", "int"), F.array_max(F.transform(cells, lambda c: c["row_index"] + 1)), F.lit(0))
        cols = F.coalesce(get("num_cols", "int"), F.array_max(F.transform(cells, lambda c: c["col_index"] + 1)), F.lit(0))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        self.has_cells = F.size(cells) > 0
        #: Rows of cells' texts; of several cells in one place the last counts, places without one are empty.
        self.grid = F.when(self.has_cells, F.transform(upto(rows), lambda r: F.transform(upto(cols), lambda c: place_of(cells, r, c)))).otherwise(F.transform(upto(rows), lambda r: F.transform(upto(cols), lambda c: F.lit(""))))
        self.merged = F.exists(cells, lambda c: (F.coalesce(c["row_span"], F.lit(1)) > 1) | (F.coalesce(c["col_span"], F.lit(1)) > 1))
        self.source = asset(F.lit("image/png"), self.image, F.col("block_id"))["src"]

    def origin(self, text: Column) -> Column:
        """[text] if the block's provenance is known, else nothing."""
        if self.provenance is None:
            return F.array().cast("array<string>")
        return F.when(self.provenance.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def place_of(cells: Column, row: Column, col: Column) -> Column:
    """The text of the last cell that begins there, or an empty one."""
    here = F.filter(cells, lambda x: (x["row_index"] == row) & (x["col_index"] == col))
    return F.coalesce(F.get(here, F.size(here) - 1)["text"], F.lit(""))


def asset(mime: Column, payload: Column, asset_id: Column, folder: str | None = None) -> Column:
    """struct<src, path, warning> of an image: a data URI, or a path below `folder`; a drawing that says so where it is missing."""
    missing = F.concat(
        F.lit("data:image/svg+xml;utf8,<svg xmlns='http://www.w3.org/2000/svg' width='200' height='80'><rect width='100%' height='100%' fill='%23f3f4f6' rx='4'/><text x='50%' y='50%' dominant-baseline='middle' text-anchor='middle' font-family='sans-serif' font-size='12' fill='%236b7280'>[Missing Image: "),
        asset_id, F.lit("]</text></svg>"),
    )
    none, path = F.lit(None).cast("string"), F.concat(F.lit(f"{folder}/"), asset_id, F.when(mime.contains("png"), ".png").otherwise(".jpg"))
    there = F.struct(F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(payload)).alias("src"), none.alias("path"), none.alias("warning")) if folder is None else F.struct(path.alias("src"), path.alias("path"), none.alias("warning"))
    lost = F.struct(missing.alias("src"), none.alias("path"), F.concat(F.lit("Image asset '"), asset_id, F.lit("' has no binary content.")).alias("warning"))
    return F.when(payload.isNull() | (F.length(payload) == 0), lost).otherwise(there)


def _if(there: Column, text: Column) -> Column:
    return F.when(there, F.array(text)).otherwise(F.array().cast("array<string>"))


def _table_markdown(p: Parts) -> Column:
    tr = F.transform(p.grid, lambda row: F.concat(F.array(F.lit("    <tr>")), F.transform(row, lambda t: F.concat(F.lit("      <td>"), t, F.lit("</td>"))), F.array(F.lit("    </tr>"))))
    html = F.concat(F.array(F.lit("<table>"), F.lit("  <tbody>")), F.flatten(tr), F.array(F.lit("  </tbody>"), F.lit("</table>")))
    pipe = F.transform(p.grid, lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(p.grid, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    plain = F.concat(F.slice(pipe, 1, 1), F.array(rule), F.slice(pipe, 2, F.greatest(F.size(pipe) - 1, F.lit(0))))
    return F.when(p.merged, html).when(F.size(p.grid) == 0, F.array(F.lit("*Empty Table*"))).otherwise(plain)


def markdown_block(blocks: DataFrame, provenance: bool = True) -> Column:
    """A block's lines in Markdown, a blank one last."""
    p = Parts(blocks)
    body = F.when(p.kind == "heading", F.array(F.concat(F.repeat(F.lit("#"), p.level), F.lit(" "), p.text)))
    body = body.when(p.kind == "list", F.transform(p.items, lambda x: F.concat(F.when(p.ordered, "1. ").otherwise("- "), x)))
    body = body.when(p.kind == "table", _table_markdown(p))
    body = body.when(p.kind == "figure", F.concat(F.array(F.concat(F.lit("!["), "block_id", F.lit("]("), p.source, F.lit(")"))), _if(F.coalesce(p.caption, F.lit("")) != "", F.concat(F.lit("*"), p.caption, F.lit("*")))))
    body = body.when(p.kind == "formula", F.array(F.lit("$$"), p.expression, F.lit("$$"))).otherwise(F.array(p.text))
    note = p.origin(F.concat(F.lit("<!-- provenance: provider="), F.coalesce("provenance.provider", F.lit("")), F.lit(" stage="), F.coalesce("provenance.stage", F.lit("")), F.lit(" -->"))) if provenance and p.provenance is not None else F.array().cast("array<string>")
    return F.concat(note, body, F.array(F.lit("")))


def html_block(blocks: DataFrame, provenance: bool = True) -> Column:
    """A block's lines in HTML, indented as they stand in a page's section."""
    p = Parts(blocks)
    known = F.concat(F.lit(' data-provider="'), F.coalesce("provenance.provider", F.lit("")), F.lit('" data-stage="'), F.coalesce("provenance.stage", F.lit("")), F.lit('"')) if p.provenance is not None else F.lit("")
    data = F.when(p.provenance.isNotNull(), known).otherwise("") if provenance and p.provenance is not None else F.lit("")
    one = lambda tag, inner, attrs="": F.array(F.concat(F.lit(f"      <{tag}{attrs}"), data, F.lit(">"), inner, F.lit(f"</{tag}>")))
    level = p.level.cast("string")
    heading = F.array(F.concat(F.lit("      <h"), level, data, F.lit(">"), p.text, F.lit("</h"), level, F.lit(">")))
    tag = F.when(p.ordered, "ol").otherwise("ul")
    listed = F.concat(F.array(F.concat(F.lit("      <"), tag, data, F.lit(">"))), F.transform(p.items, lambda x: F.concat(F.lit("        <li>"), x, F.lit("</li>"))), F.array(F.concat(F.lit("      </"), tag, F.lit(">"))))
    tr = F.transform(p.grid, lambda row: F.concat(F.array(F.lit("          <tr>")), F.transform(row, lambda t: F.concat(F.lit("            <td>"), t, F.lit("</td>"))), F.array(F.lit("          </tr>"))))
    table = F.concat(F.array(F.concat(F.lit("      <table"), data, F.lit(">")), F.lit("        <tbody>")), F.flatten(tr), F.array(F.lit("        </tbody>"), F.lit("      </table>")))
    figure = F.concat(F.array(F.concat(F.lit("      <figure"), data, F.lit(">")), F.concat(F.lit('        <img src="'), p.source, F.lit('" alt="'), "block_id", F.lit('">'))), _if(F.coalesce(p.caption, F.lit("")) != "", F.concat(F.lit("        <figcaption>"), p.caption, F.lit("</figcaption>"))), F.array(F.lit("      </figure>")))
    out = F.when(p.kind == "heading", heading).when(p.kind == "paragraph", one("p", p.text)).when(p.kind == "list", listed).when(p.kind == "table", table).when(p.kind == "figure", figure)
    return out.when(p.kind == "formula", one("div", F.concat(F.lit("$$"), p.expression, F.lit("$$")), ' class="formula"')).otherwise(one("div", p.text))


def text_block(blocks: DataFrame) -> Column:
    """A block's lines in plain text, a blank one last."""
    p = Parts(blocks)
    figure = F.concat(F.array(F.concat(F.lit("[Figure: "), "block_id", F.lit("]"))), _if(F.coalesce(p.caption, F.lit("")) != "", F.concat(F.lit("Caption: "), p.caption)))
    out = F.when(p.kind == "heading", F.array(F.upper(p.text))).when(p.kind == "list", F.transform(p.items, lambda x: F.concat(F.when(p.ordered, "- ").otherwise("* "), x)))
    out = out.when(p.kind == "table", F.transform(p.grid, lambda row: F.array_join(row, " | "))).when(p.kind == "figure", figure).when(p.kind == "formula", F.array(F.concat(F.lit("Equation: "), p.expression))).otherwise(F.array(p.text))
    return F.concat(out, F.array(F.lit("")))


def warnings_of(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, warning: what a text format can't hold."""
    p = Parts(blocks)
    merged = F.when((p.kind == "table") & p.merged, F.lit(MERGED_WARNING))
    raster = F.when(p.kind == "figure", F.concat(F.lit("Raster image block '"), "block_id", F.lit("' replaced with text placeholder.")))
    return blocks.select("doc_id", "block_id", F.coalesce(merged, raster).alias("warning")).where("warning is not null")


def _joined(df: DataFrame, by: list[str], order: str, piece: str, sep: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(piece))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x[piece]), sep).alias(piece))


def pages_of(blocks: DataFrame, lines: Column) -> DataFrame:
    """doc_id, part, body: the lines of each page's blocks in order; part is the page's index."""
    d = blocks.select("doc_id", "page_index", "pos", F.array_join(lines, "\n").alias("body"))
    return _joined(d, ["doc_id", "page_index"], "pos", "body", "\n").withColumnRenamed("page_index", "part")


def _title(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Document"))


def markdown_parts(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, part, body; a document is its parts joined by line breaks. documents: doc_id, doc_name, author, created_at."""
    about = F.concat(F.array(F.concat(F.lit("# "), _title(F.col("doc_name")))), _if(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("**Author:** "), "author")), _if(F.coalesce("created_at", F.lit("")) != "", F.concat(F.lit("**Date:** "), "created_at")), F.array(F.lit("")))
    head = documents.select("doc_id", F.lit(HEAD).alias("part"), F.array_join(about, "\n").alias("body"))
    return head.unionByName(pages_of(blocks, markdown_block(blocks)))


def html_parts(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    title = _title(F.col("doc_name"))
    first = ["<!DOCTYPE html>", "<html>", "<head>", '  <meta charset="utf-8">']
    author = _if(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("    <p><strong>Author:</strong> "), "author", F.lit("</p>")))
    lines = F.concat(F.array(*map(F.lit, first), F.concat(F.lit("  <title>"), title, F.lit("</title>")), F.lit("</head>"), F.lit("<body>"), F.lit('  <header class="document-header">'), F.concat(F.lit("    <h1>"), title, F.lit("</h1>"))), author, F.array(F.lit("  </header>"), F.lit('  <main class="document-body">')))
    head = documents.select("doc_id", F.lit(HEAD).alias("part"), F.array_join(lines, "\n").alias("body"))
    end = documents.select("doc_id", F.lit(END).alias("part"), F.lit("  </main>\n</body>\n</html>").alias("body"))
    pages = pages_of(blocks, html_block(blocks))
    section = F.concat(F.lit('    <section class="page" data-page-index="'), F.col("part").cast("string"), F.lit('">\n'), "body", F.lit("\n    </section>"))
    return head.unionByName(pages.withColumn("body", section)).unionByName(end)


def text_parts(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    head = documents.select("doc_id", F.lit(HEAD).alias("part"), F.concat(F.lit("DOCUMENT: "), _title(F.col("doc_name")), F.lit("\n" + "=" * 40 + "\n")).alias("body"))
    pages = pages_of(blocks, text_block(blocks))
    return head.unionByName(pages.withColumn("body", F.concat(F.lit("--- Page "), (F.col("part") + 1).cast("string"), F.lit(" ---\n"), "body")))


def document_of(parts: DataFrame) -> DataFrame:
    """doc_id, body: a document in one string, for documents that a task can hold."""
    return _joined(parts, ["doc_id"], "part", "body", "\n")


ARCHIVAL_STYLE = (
    "  <style>\n    @page { size: A4; margin: 20mm; }\n    body { font-family: Arial, sans-serif; line-height: 1.5; color: #000; }\n    h1, h2, h3 { color: #111; page-break-after: avoid; }\n"
    "    p { margin-bottom: 1em; orphans: 2; widows: 2; }\n    table { width: 100%; border-collapse: collapse; margin: 1em 0; }\n    th, td { border: 1px solid #666; padding: 6px; text-align: left; }\n  </style>\n"
)


def archival_parts(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """Parts of HTML documents with a frame that marks them for archiving; documents: doc_id, title."""
    d = documents.select("doc_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("PDF/A Document")).alias("title"))
    first = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8">\n  <meta name="pdfa-compliance" content="PDF/A-2b">\n  <title>'), "title", F.lit("</title>\n" + ARCHIVAL_STYLE + "</head>\n<body>"))
    edge = split_join(parts.where(F.col("part") == HEAD), d, ["doc_id"], ["part"]).select("doc_id", "part", F.concat(first, "body").alias("body"))
    end = parts.where(F.col("part") == END).select("doc_id", "part", F.concat("body", F.lit("</body>\n</html>")).alias("body"))
    return edge.unionByName(parts.where(F.col("part").between(HEAD + 1, END - 1)).select("doc_id", "part", "body")).unionByName(end)


def json_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, page_index, body: the blocks as JSON, nulls kept; json_pages reads them back."""
    cols = [c for c in blocks.columns if c not in ("doc_id", "page_index")]
    rows = F.array_sort(F.collect_list(F.struct("pos", *[c for c in cols if c != "pos"])))
    return blocks.groupBy("doc_id", "page_index").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("body"))


def parsed_blocks(pages: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of json_blocks; schema: that of a block."""
    return pages.select("doc_id", "page_index", F.explode(F.from_json("body", T.ArrayType(schema))).alias("b")).select("doc_id", "page_index", "b.*")


def table_markdown(cells: DataFrame) -> DataFrame:
    """table_id, row_index, col_index, pos, text, row_span, col_span -> table_id, body. Row 0 is the head; of two cells in one
    place the later one counts; places without a cell are empty; a table in which a cell spans several places is HTML."""
    last = cells.groupBy("table_id", "row_index", "col_index").agg(F.max_by("text", "pos").alias("text"), F.max(F.greatest("row_span", "col_span")).alias("span"))
    size = last.groupBy("table_id").agg(F.max("row_index").alias("r"), F.max("col_index").alias("c"), F.max("span").alias("span"))
    grid = size.select("table_id", "c", "span", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("row_index")).select("*", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("col_index"))
    full = grid.join(last.drop("span"), ["table_id", "row_index", "col_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = full.groupBy("table_id", "row_index", "c", "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: x["text"]).alias("ts"))
    pipe = F.concat(F.lit("| "), F.array_join("ts", " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("c") + 1), " | "), F.lit(" |"))
    tr = F.concat(F.lit("    <tr>\n"), F.array_join(F.transform("ts", lambda t: F.concat(F.lit("      <td>"), t, F.lit("</td>\n"))), ""), F.lit("    </tr>"))
    line = F.when(F.col("span") > 1, tr).when(F.col("row_index") == 0, F.concat(pipe, rule)).otherwise(pipe)
    out = _joined(rows.select("table_id", "span", "row_index", line.alias("body")), ["table_id", "span"], "row_index", "body", "\n")
    return out.select("table_id", F.when(F.col("span") > 1, F.concat(F.lit("<table>\n  <tbody>\n"), "body", F.lit("\n  </tbody>\n</table>"))).otherwise(F.col("body")).alias("body"))


def chunk_type() -> Column:
    k = _kind()
    return F.when(k.isin("heading", "table", "figure", "formula"), k).otherwise("paragraph")


def _chunk_text(blocks: DataFrame) -> Column:
    """A block's text, stripped; of those without one that of their parts."""
    p = Parts(blocks)
    rows = F.array_join(F.transform(p.grid, lambda r: F.array_join(r, " | ")), "\n")
    t = F.when(p.kind == "list", F.array_join(p.items, "\n")).when(p.kind == "formula", p.expression).when(p.kind == "figure", F.coalesce(p.caption, F.lit(""))).when(p.kind == "table", F.when(p.text == "", rows).otherwise(p.text)).otherwise(p.text)
    return strip(t)


def _metadata(blocks: DataFrame) -> list[Column]:
    """Of a chunk: its box, caption, formula and rows of cells."""
    p = Parts(blocks)
    boxed = "bbox" in blocks.columns
    sides = F.array(*[F.round(F.col(f"bbox.box_{x}"), 4) for x in ("left", "top", "right", "bottom")]) if boxed else F.lit(None).cast("array<double>")
    box = F.when(F.col("bbox").isNotNull(), sides) if boxed else sides
    return [box.alias("bbox"), F.when(p.kind == "figure", p.caption).alias("figure_caption"), F.when(p.kind == "formula", F.nullif(p.expression, F.lit(""))).alias("formula_latex"), F.when((p.kind == "table") & p.has_cells, p.grid).alias("table_matrix")]


def rag_chunks(blocks: DataFrame, pages_in_block: int = 200) -> DataFrame:
    """A chunk for each block with text: chunk_id, doc_id, page_index, chunk_type, text, bbox, figure_caption, formula_latex,
    table_matrix and n_headings: how many headings of the document there are up to and with it. All of those are
    its hierarchy, as the stack is only ever added to, so the document's list of headings (heading_list) and a number say the same
    as a list in every chunk; with_hierarchy puts it there. Blank headings count, though they are no chunks."""
    b = blocks.withColumn("chunk_text", _chunk_text(blocks))
    b = running_count(b, "doc_id", F.floor(F.col("page_index") / pages_in_block), ["page_index", "pos"], _kind() == "heading", "n_headings")
    return _chunk_rows(b, _metadata(blocks), "n_headings")


def heading_list(blocks: DataFrame) -> DataFrame:
    """doc_id, headings: the headings of each document in order."""
    h = blocks.where(_kind() == "heading").select("doc_id", "page_index", "pos", strip(F.coalesce("text", F.lit(""))).alias("t"))
    return h.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "pos", "t"))), lambda x: x["t"]).alias("headings"))


def with_hierarchy(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """Chunks with heading_hierarchy, the list itself: its size grows with the square of a document's headings, so it is for
    documents of some length only; nested_chunks has the enclosing headings."""
    c = split_join(chunks, headings, ["doc_id"], ["chunk_id"], how="left")
    return c.withColumn("heading_hierarchy", F.coalesce(F.slice("headings", F.lit(1), F.col("n_headings").cast("int")), F.array().cast("array<string>"))).drop("headings")


def nested_chunks(blocks: DataFrame, pages_in_block: int = 200) -> DataFrame:
    """As rag_chunks, with the headings that enclose a chunk only: the last of each level above the last heading's.

    The last heading of each level is found within blocks of pages and carried over from the blocks before, so that no
    window holds more than a block of a document."""
    keys = ["doc_id", "_part"]
    b = blocks.withColumn("chunk_text", _chunk_text(blocks)).withColumn("_part", F.floor(F.col("page_index") / pages_in_block))
    level = F.when((_kind() == "heading") & (F.col("chunk_text") != ""), F.coalesce("heading_level", F.lit(1)))
    heading = F.struct("page_index", "pos", F.col("chunk_text").alias("t"))
    levels = range(1, 7)
    own = {i: F.when(F.col("_level") == i, heading) for i in levels}
    b = b.withColumn("_level", level)
    inside = Window.partitionBy(*keys).orderBy("page_index", "pos")
    before = Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(*keys).agg(*[F.max(own[i]).alias(f"_s{i}") for i in levels])
    carried = sums.select(*keys, *[F.max(f"_s{i}").over(before).alias(f"_c{i}") for i in levels])
    b = b.select("*", *[F.max(own[i]).over(inside).alias(f"_h{i}") for i in levels]).join(carried, keys)
    last = {i: F.coalesce(f"_h{i}", f"_c{i}") for i in levels}
    at = {i: F.struct(last[i]["page_index"], last[i]["pos"]) for i in levels}
    open_ = [last[1]["t"]]
    for i in levels[1:]:
        above = [last[k].isNull() | (at[i] > at[k]) for k in range(1, i)]
        ok = above[0]
        for c in above[1:]:
            ok = ok & c
        open_.append(F.when(ok, last[i]["t"]))
    return _chunk_rows(b.withColumn("heading_hierarchy", F.array_compact(F.array(*open_))), _metadata(blocks), "heading_hierarchy")


def _chunk_rows(b: DataFrame, metadata: list[Column], hierarchy: str) -> DataFrame:
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page_index").cast("string"), F.lit("_b"), "block_id")
    return b.where("chunk_text != ''").select(chunk_id.alias("chunk_id"), "doc_id", "page_index", chunk_type().alias("chunk_type"), F.col("chunk_text").alias("text"), hierarchy, *metadata)


METADATA = ("document_id", "document_name", "page_index", "chunk_type", "bbox", "heading_hierarchy", "figure_caption", "formula_latex", "table_matrix")


def vector_record(kind: str, chunks: DataFrame) -> Column:
    """A chunk as a vector store takes it, as JSON, nulls kept. The metadata are METADATA, null where `chunks` has no
    such column; doc_id is the document's id."""
    has = set(chunks.columns)
    parts = [F.col("doc_id").cast("string").alias("document_id") if m == "document_id" else F.col(m) if m in has else F.lit(None).cast("string").alias(m) for m in METADATA]
    meta, with_text = F.struct(*parts), F.struct("text", *parts)
    shape = {
        "langchain": F.struct(F.col("text").alias("page_content"), meta.alias("metadata")),
        "llamaindex": F.struct(F.col("chunk_id").alias("id_"), "text", meta.alias("extra_info")),
        "qdrant": F.struct(F.col("chunk_id").alias("id"), with_text.alias("payload")),
        "pinecone": F.struct(F.col("chunk_id").alias("id"), with_text.alias("metadata")),
        "chroma": F.struct(F.col("chunk_id").alias("id"), F.col("text").alias("document"), meta.alias("metadata")),
    }
    if kind not in shape:
        raise ValueError(f"unknown kind of record: {kind}")
    return F.to_json(shape[kind], {"ignoreNullFields": "false"})


def overlay(box: list[Column]) -> Column:
    """A block as an overlay of a page: colour, box at 4 places, the first 100 characters of its text."""
    m = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    colour = F.coalesce(F.element_at(m, _kind()), F.lit(OTHER_COLOUR))
    return F.struct("block_id", _kind().alias("type"), colour.alias("color"), F.lit(OVERLAY_CONFIDENCE).alias("confidence"), F.array(*[F.round(x, 4) for x in box]).alias("bbox"), F.substring(F.coalesce("text", F.lit("")), 1, 100).alias("text"))


_CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_W = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
)


def _zip(parts: list[tuple[str, str | bytes, bool]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body, packed in parts:
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED
            z.writestr(info, body)
    return out.getvalue()


def _run(text: str) -> str:
    return f'<w:r><w:t xml:space="preserve">{escape(_xml_text(text))}</w:t></w:r>'


def _picture(n: int) -> str:
    """A picture two inches wide, by the number of its relation."""
    size = 'cx="1828800" cy="1828800"'
    return (
        f'<w:p><w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="{n}" name="Picture {n}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic>'
        f'<pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}.png"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rImg{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    )


def docx(rows: list[tuple]) -> bytes:
    """A word processor's file of (kind, text, level) paragraphs, ("table", rows of texts, 0) and ("picture", bytes, 0)."""
    style = {"heading": lambda n: f"Heading{max(1, min(4, n or 1))}", "ordered": lambda n: "ListNumber", "list": lambda n: "ListBullet"}
    body, images = [], []
    for kind, content, level in rows:
        if kind == "table":
            trs = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{_run(t)}</w:p></w:tc>" for t in r) + "</w:tr>" for r in content)
            body.append(f"<w:tbl>{trs}</w:tbl>")
        elif kind == "picture":
            images.append(content)
            body.append(_picture(len(images)))
        else:
            s = f'<w:pPr><w:pStyle w:val="{style[kind](level)}"/></w:pPr>' if kind in style else ""
            body.append(f"<w:p>{s}{_run(content)}</w:p>")
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_W}><w:body>{"".join(body)}</w:body></w:document>'
    links = "".join(f'<Relationship Id="rImg{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/image{i}.png"/>' for i in range(1, len(images) + 1))
    rels = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    parts: list[tuple] = [("[Content_Types].xml", _CONTENT_TYPES, True), ("_rels/.rels", _RELS, True), ("word/document.xml", document, True), ("word/_rels/document.xml.rels", rels, True)]
    return _zip(parts + [(f"word/media/image{i}.png", x, False) for i, x in enumerate(images, 1)])


def _xml_text(s: str) -> str:
    return "".join(c for c in s if c in "\t\n\r" or ord(c) >= 32 and not 0xD800 <= ord(c) <= 0xDFFF)


# The parts of an e-book that are the same in all.
EPUB_CONTAINER = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n  <rootfiles>\n    <rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>'
EPUB_STYLE = "body { font-family: sans-serif; line-height: 1.6; margin: 1em; }\nh1, h2, h3 { color: #111827; margin-top: 1.5em; }\np { margin-bottom: 1em; text-align: justify; }\ntable { width: 100%; border-collapse: collapse; margin: 1em 0; }\nth, td { border: 1px solid #d1d5db; padding: 0.5em; text-align: left; }\n"
EPUB_ID = "urn:uuid:12345678-1234-1234-1234-123456789abc"


def epub(title: str, html: str) -> bytes:
    """An e-book of one chapter; the mimetype comes first and isn't compressed."""
    t = escape(_xml_text(title))
    opf = (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="BookID" version="2.0">\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n    <dc:title>{t}</dc:title>\n    <dc:language>en</dc:language>\n    <dc:identifier id="BookID">{EPUB_ID}</dc:identifier>\n  </metadata>\n'
        '  <manifest>\n    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n    <item id="style" href="styles.css" media-type="text/css"/>\n    <item id="chapter1" href="chapter1.xhtml" media-type="application/xhtml+xml"/>\n  </manifest>\n  <spine toc="ncx">\n    <itemref idref="chapter1"/>\n  </spine>\n</package>'
    )
    chapter = f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head>\n  <title>{t}</title>\n  <link rel="stylesheet" type="text/css" href="styles.css"/>\n</head>\n<body>\n{html}\n</body>\n</html>'
    ncx = f'<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n  <head>\n    <meta name="dtb:uid" content="{EPUB_ID}"/>\n  </head>\n  <docTitle><text>{t}</text></docTitle>\n  <navMap>\n    <navPoint id="navpoint-1" playOrder="1">\n      <navLabel><text>{t}</text></navLabel>\n      <content src="chapter1.xhtml"/>\n    </navPoint>\n  </navMap>\n</ncx>'
    files = [("META-INF/container.xml", EPUB_CONTAINER), ("OEBPS/styles.css", EPUB_STYLE), ("OEBPS/chapter1.xhtml", chapter), ("OEBPS/content.opf", opf), ("OEBPS/toc.ncx", ncx)]
    return _zip([("mimetype", "application/epub+zip", False), *[(n, x, True) for n, x in files]])


def docx_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, part, content: a Word file of each page. Pages are the unit, so that no file grows with the largest document."""
    p = Parts(blocks)
    kind = F.when((p.kind == "list") & p.ordered, "ordered").otherwise(p.kind)
    row = F.struct("pos", kind.alias("kind"), p.text.alias("text"), p.level.alias("level"), p.items.alias("items"), p.grid.alias("grid"), p.image.alias("image"), p.caption.alias("caption"), p.expression.alias("expression"))
    rows = blocks.groupBy("doc_id", F.col("page_index").alias("part")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def flat(r) -> Iterator[tuple]:
        kind = r["kind"]
        if kind in ("list", "ordered"):
            yield from ((kind, t, 0) for t in r["items"])
        elif kind == "table":
            if len(r["grid"]):
                yield "table", [list(x) for x in r["grid"]], 0
        elif kind == "figure":
            if r["image"]:
                yield "picture", r["image"], 0
            if r["caption"]:
                yield "plain", f"Caption: {r['caption']}", 0
        else:
            yield kind, f"Equation: {r['expression']}" if kind == "formula" else r["text"], int(r["level"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "part"]].assign(content=[docx([x for r in rs for x in flat(r)]) for rs in pdf.rows])

    return rows.mapInPandas(run, "doc_id long, part int, content binary")


def epub_documents(parts: DataFrame, titles: DataFrame) -> DataFrame:
    """HTML parts (doc_id, part, body) -> doc_id, part, content: an e-book of each page, under its document's title."""
    named = split_join(parts.where(F.col("part").between(HEAD + 1, END - 1)), titles.select("doc_id", "title"), ["doc_id"], ["part"], how="left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "part"]].assign(content=[epub(t or "Document", b) for t, b in zip(pdf.title, pdf.body, strict=True)])

    return named.select("doc_id", "part", "title", "body").mapInPandas(run, "doc_id long, part int, content binary")
