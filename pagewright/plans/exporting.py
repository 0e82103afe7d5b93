"""Queries that write blocks in the formats of export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.scratch import written
from pagewright.functions.tables import once, table
from pagewright.operators import export as E
from pagewright.operators.shred import flat_table, shred
from pagewright.plans.laying_out import _SP
from pagewright.plans.nested import _NUMBERED, REPEATED, _get


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "blocks").select("block_uid", "doc_id", "page_index", "pos", "block_id", "block_type", "text", "heading_level", "ordered", "list_items", "bbox", "provenance"), "block_uid")


_BLOCKS = "b AS (SELECT DISTINCT block_uid, doc_id, page_index, pos, block_id, lower(block_type) AS k, coalesce(text, '') AS t, heading_level, coalesce(greatest(1, least(6, heading_level)), 1) AS lv, coalesce(ordered, false) AS ordered, list_transform(coalesce(list_items, []), lambda x: coalesce(x.text, '')) AS li, bbox, provenance AS pr, CASE WHEN lower(block_type) = 'figure' THEN text END AS cap, coalesce(text, '') AS ex, []::VARCHAR[][] AS grid, false AS merged FROM blocks)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("doc_name", "title", "author", "created_at")])


_FILES = "n AS (SELECT doc_id, max(doc_name) AS doc_name, max(title) AS title, max(author) AS author, max(created_at) AS created_at FROM files GROUP BY 1)"


def _digest(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", "part", F.md5("body").alias("digest"), F.length("body").alias("n_chars"))


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(E.markdown_parts(_blocks(spark, sf_dir), _files(spark, sf_dir)))


def export_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(E.html_parts(_blocks(spark, sf_dir), _files(spark, sf_dir)))


def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(E.text_parts(_blocks(spark, sf_dir), _files(spark, sf_dir)))


def _record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of nested records, with their list items and cells."""
    names = {"id": "block_id", "blocktype": "block_type", "text": "text", "level": "heading_level", "caption": "caption", "expression": "expression", "ordered": "ordered", "numrows": "num_rows", "numcols": "num_cols"}
    parts = {"text": "text", "rowindex": "row_index", "colindex": "col_index", "rowspan": "row_span", "colspan": "col_span"}
    rows = written(shred(table(spark, sf_dir, "doc_records"), "pages", REPEATED, [*names, *parts, "value"], ["blocks", "children", "items", "cells"]), "shredded")
    of = [F.col("rec_id"), F.col("parent_path").alias("path"), F.col("parent_n").alias("n")]
    number = lambda c: F.col(c).try_cast("int").alias(c)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", "value").alias("text")))), lambda x: F.struct(x["text"].alias("text"), F.lit("").alias("marker"), x["place"].alias("reading_order_index")))
    items = flat_table(rows, ["items"], {"text": "text", "value": "value"}).groupBy(*of).agg(listed.alias("list_items"))
    cell = F.struct("place", number("row_index"), number("col_index"), number("row_span"), number("col_span"), "text")
    held = F.transform(F.array_sort(F.collect_list(cell)), lambda x: F.struct(*[x[c].alias(c) for c in ("row_index", "col_index", "row_span", "col_span", "text")]))
    cells = flat_table(rows, ["cells"], parts).groupBy(*of).agg(held.alias("cells"))
    b = flat_table(rows, ["blocks", "children"], names).join(items, ["rec_id", "path", "n"], "left").join(cells, ["rec_id", "path", "n"], "left")
    depth = (F.size(F.split("path", r"\.")) + F.coalesce(F.regexp_extract("path", r"\^(\d+)", 1).try_cast("int"), F.lit(1))) * 1_000_000
    return b.select(
        F.col("rec_id").alias("doc_id"), (F.col("top_n") - 1).alias("page_index"), (depth + F.col("n")).alias("pos"), "block_id", F.coalesce("block_type", F.lit("text")).alias("block_type"), "text", number("heading_level"),
        F.col("ordered").try_cast("boolean").alias("ordered"), "list_items", "caption", "expression", number("num_rows"), number("num_cols"), "cells",
    )


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of nested records, tables with their cells, in Markdown, HTML and plain text."""
    b = written(_record_blocks(spark, sf_dir), "blocks")
    forms = [(k, E.pages_of(b, f(b))) for k, f in (("markdown", E.markdown_block), ("html", E.html_block), ("text", E.text_block))]
    out = [_digest(d).withColumn("format", F.lit(k)) for k, d in forms]
    return out[0].unionByName(out[1]).unionByName(out[2])


def export_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.warnings_of(_blocks(spark, sf_dir)).select("doc_id", "block_id", "warning")


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as JSON and read back: the same rows."""
    b = _blocks(spark, sf_dir).drop("provenance", "bbox")
    back = E.parsed_blocks(E.json_blocks(b), b.drop("doc_id", "page_index").schema)
    return back.select("block_uid", "doc_id", "page_index", "pos", "block_id", "block_type", "text", "heading_level", F.size(F.coalesce("list_items", F.array())).alias("n_items"))


def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.rag_chunks(_blocks(spark, sf_dir))
    return c.select("chunk_id", "page_index", "chunk_type", "text", "n_headings", F.col("bbox")[0].alias("box_left"), "formula_latex")


def rag_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    c = E.with_hierarchy(E.rag_chunks(b), E.heading_list(b))
    return c.select("chunk_id", F.size("heading_hierarchy").alias("n_headings"), F.md5(F.array_join("heading_hierarchy", "|")).alias("headings"))


def rag_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.nested_chunks(_blocks(spark, sf_dir))
    return c.select("chunk_id", "chunk_type", F.array_join("heading_hierarchy", " > ").alias("path"))


_CHUNKS = rf"{_BLOCKS}, c AS (SELECT *, regexp_replace(CASE WHEN k = 'list' THEN coalesce(array_to_string(li, chr(10)), '') ELSE t END, '^{_SP}+|{_SP}+$', '', 'g') AS ct FROM b)"
_CHUNK_ID = "doc_id || '_p' || page_index || '_b' || block_id AS chunk_id"
_CHUNK_TYPE = "CASE WHEN k IN ('heading', 'table', 'figure', 'formula') THEN k ELSE 'paragraph' END AS chunk_type"
_LEVELS = ", ".join(f"last_value(CASE WHEN hl = {i} THEN ct END IGNORE NULLS) OVER w AS h{i}, last_value(CASE WHEN hl = {i} THEN o END IGNORE NULLS) OVER w AS o{i}, last_value(CASE WHEN hl < {i} THEN o END IGNORE NULLS) OVER w AS u{i}" for i in range(1, 7))
_PATH = ", ".join(f"CASE WHEN u{i} IS NULL OR o{i} > u{i} THEN h{i} END" for i in range(1, 7))


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks table as records of five vector stores."""
    c = table(spark, sf_dir, "chunks").select("chunk_uid", "chunk_id", "doc_id", "document_name", "page_index", "chunk_type", "text", "bbox", "heading_hierarchy", "figure_caption").distinct()
    c = c.withColumn("bbox", F.transform("bbox", lambda x: F.round(x, 4))).withColumn("formula_latex", F.when(F.col("chunk_type") == "formula", F.col("text")))
    kinds = ("langchain", "llamaindex", "qdrant", "pinecone", "chroma")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), E.vector_record(k, c).alias("record")) for k in kinds]))
    r = c.select("chunk_uid", rows.alias("r")).select("chunk_uid", "r.kind", "r.record")
    body = F.coalesce(*[F.get_json_object("record", p) for p in ("$.page_content", "$.text", "$.payload.text", "$.metadata.text", "$.document")])
    of = lambda f: F.coalesce(*[F.get_json_object("record", f"$.{p}.{f}") for p in ("metadata", "payload", "extra_info")])
    return r.select("chunk_uid", "kind", F.md5(body).alias("text_digest"), of("page_index").cast("int").alias("page_index"), of("document_id").alias("document_id"), of("document_name").alias("document_name"), of("bbox[0]").cast("double").alias("box_left"), F.md5(of("figure_caption")).alias("caption_digest"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each order as a table; orders of three lines have a cell that spans two places."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).cast("int").alias("row_index")).agg(F.max("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("l_returnflag"))
    span = F.when(F.max("row_index").over(E.Window.partitionBy("table_id")) == 2, 2).otherwise(1)
    li = li.withColumn("col_span", span)
    cells = li.select("table_id", "row_index", F.lit(0).alias("col_index"), F.col("l_partkey").cast("string").alias("text"), "col_span").unionByName(li.select("table_id", "row_index", F.lit(1).alias("col_index"), F.col("l_returnflag").alias("text"), "col_span"))
    return E.table_markdown(cells.withColumn("row_span", F.lit(1)).withColumn("pos", F.lit(0)))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a box as overlays of their page, whose size comes with them."""
    b = once(table(spark, sf_dir, "blocks").where("bbox is not null").select("block_uid", "doc_id", "page_index", "block_id", "block_type", "text", "bbox"), "block_uid")
    pages = table(spark, sf_dir, "raw_pages").groupBy("doc_id", "page_index").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    o = E.overlay([F.col(f"bbox.box_{x}") for x in ("left", "top", "right", "bottom")])
    d = b.join(pages, ["doc_id", "page_index"], "left").select("block_uid", o.alias("o"), "width", "height")
    return d.select("block_uid", "o.type", "o.color", "o.confidence", F.col("o.bbox")[0].alias("box_left"), "o.text", "width", "height")


def figure_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, of which every other one has a picture, as data and as files."""
    b = _blocks(spark, sf_dir).where("lower(block_type) = 'figure'")
    payload = F.when(F.col("block_uid") % 2 == 0, F.encode("block_id", "UTF-8"))
    a, f = E.asset(F.lit("image/png"), payload, F.col("block_id")), E.asset(F.lit("image/png"), payload, F.col("block_id"), "assets")
    return b.select("block_uid", a["src"].alias("uri"), a["warning"].alias("warning"), f["path"].alias("path"))


def binary_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files and e-books of pages; whether they are archives."""
    b = _blocks(spark, sf_dir)
    books = E.epub_documents(E.html_parts(b, _files(spark, sf_dir)), _files(spark, sf_dir))
    parts = [d.select("doc_id", "part", F.lit(k).alias("kind"), (F.hex(F.substring("content", 1, 2)) == "504B").alias("is_zip")) for k, d in (("docx", E.docx_documents(b)), ("epub", books))]
    return parts[0].unionByName(parts[1])


def archival_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    p = E.archival_parts(E.html_parts(_blocks(spark, sf_dir), f), f)
    return p.select("doc_id", "part", F.length(F.encode("body", "UTF-8")).alias("n_bytes"))


def queries() -> dict:
    return {
        "export_markdown": export_markdown, "export_html": export_html, "export_text": export_text, "export_records": export_records, "export_warnings": export_warnings, "export_json": export_json, "rag_chunks": rag_chunks, "rag_hierarchy": rag_hierarchy, "rag_nested": rag_nested, "vector_records": vector_records,
        "table_markdown": table_markdown, "overlay": overlay, "figure_assets": figure_assets, "binary_exports": binary_exports, "archival_export": archival_export,
    }


def oracle_sql() -> dict[str, str]:
    nl = "chr(10)"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lines = lambda *xs: "[" + ", ".join(xs) + "]"
    text = lambda x: f"array_to_string({x}, {nl})"
    drawing = "data:image/svg+xml;utf8,<svg xmlns='http://www.w3.org/2000/svg' width='200' height='80'><rect width='100%' height='100%' fill='%23f3f4f6' rx='4'/><text x='50%' y='50%' dominant-baseline='middle' text-anchor='middle' font-family='sans-serif' font-size='12' fill='%236b7280'>[Missing Image: "
    missing = quoted(drawing) + " || block_id || ']</text></svg>'"
    caption = lambda x: f"CASE WHEN coalesce(cap, '') <> '' THEN [{x}] ELSE [] END"
    pipe = lambda x: f"'| ' || array_to_string({x}, ' | ') || ' |'"
    cells = lambda pad: f"flatten(list_transform(grid, lambda r: list_concat(['{pad}<tr>'], list_transform(r, lambda x: '{pad}  <td>' || x || '</td>'), ['{pad}</tr>'])))"
    tabled = f"CASE WHEN merged THEN list_concat(['<table>', '  <tbody>'], {cells('    ')}, ['  </tbody>', '</table>']) WHEN len(grid) = 0 THEN ['*Empty Table*'] ELSE list_concat([{pipe('grid[1]')}, {pipe("list_transform(grid[1], lambda x: '---')")}], list_transform(grid[2:], lambda r: {pipe('r')})) END"
    note = "CASE WHEN pr IS NOT NULL THEN ['<!-- provenance: provider=' || coalesce(pr.provider, '') || ' stage=' || coalesce(pr.stage, '') || ' -->'] ELSE [] END"
    starred = caption("'*' || cap || '*'")
    md = f"""list_concat({note}, CASE k WHEN 'heading' THEN [repeat('#', lv) || ' ' || t] WHEN 'list' THEN list_transform(li, lambda x: CASE WHEN ordered THEN '1. ' ELSE '- ' END || x) WHEN 'table' THEN {tabled}
        WHEN 'figure' THEN list_concat(['![' || block_id || '](' || {missing} || ')'], {starred}) WHEN 'formula' THEN ['$$', ex, '$$'] ELSE [t] END, [''])"""
    data = "CASE WHEN pr IS NOT NULL THEN ' data-provider=\"' || coalesce(pr.provider, '') || '\" data-stage=\"' || coalesce(pr.stage, '') || '\"' ELSE '' END"
    under = caption("'        <figcaption>' || cap || '</figcaption>'")
    html = f"""CASE k WHEN 'heading' THEN ['      <h' || lv || {data} || '>' || t || '</h' || lv || '>'] WHEN 'paragraph' THEN ['      <p' || {data} || '>' || t || '</p>']
        WHEN 'list' THEN list_concat(['      <' || CASE WHEN ordered THEN 'ol' ELSE 'ul' END || {data} || '>'], list_transform(li, lambda x: '        <li>' || x || '</li>'), ['      </' || CASE WHEN ordered THEN 'ol' ELSE 'ul' END || '>'])
        WHEN 'table' THEN list_concat(['      <table' || {data} || '>', '        <tbody>'], {cells('          ')}, ['        </tbody>', '      </table>']) WHEN 'figure' THEN list_concat(['      <figure' || {data} || '>', '        <img src="' || {missing} || '" alt="' || block_id || '">'], {under}, ['      </figure>'])
        WHEN 'formula' THEN ['      <div class="formula"' || {data} || '>$$' || ex || '$$</div>'] ELSE ['      <div' || {data} || '>' || t || '</div>'] END"""
    loud = "t"
    for letter, big in (("ß", "SS"), ("ﬀ", "FF"), ("ﬁ", "FI"), ("ﬂ", "FL"), ("ﬃ", "FFI"), ("ﬄ", "FFL"), ("ﬅ", "ST"), ("ﬆ", "ST")):  # letters whose capitals are several, which the engines treat differently
        loud = f"replace({loud}, '{letter}', '{big}')"
    called = caption("'Caption: ' || cap")
    txt = f"list_concat(CASE k WHEN 'heading' THEN [upper({loud})] WHEN 'list' THEN list_transform(li, lambda x: CASE WHEN ordered THEN '- ' ELSE '* ' END || x) WHEN 'table' THEN list_transform(grid, lambda r: array_to_string(r, ' | ')) WHEN 'figure' THEN list_concat(['[Figure: ' || block_id || ']'], {called}) WHEN 'formula' THEN ['Equation: ' || ex] ELSE [t] END, [''])"
    title = "coalesce(nullif(doc_name, ''), 'Document')"
    done = "md5(body) AS digest, length(body)::INT AS n_chars"
    page = lambda x: f"string_agg({text(x)}, {nl} ORDER BY pos)"
    about = f"list_concat(['# ' || {title}], CASE WHEN coalesce(author, '') <> '' THEN ['**Author:** ' || author] ELSE [] END, CASE WHEN coalesce(created_at, '') <> '' THEN ['**Date:** ' || created_at] ELSE [] END, [''])"
    first = lines(*map(quoted, ["<!DOCTYPE html>", "<html>", "<head>", '  <meta charset="utf-8">']), f"'  <title>' || {title} || '</title>'", "'</head>'", "'<body>'", quoted('  <header class="document-header">'), f"'    <h1>' || {title} || '</h1>'")
    main = quoted('  <main class="document-body">')
    begin = f"list_concat({first}, CASE WHEN coalesce(author, '') <> '' THEN ['    <p><strong>Author:</strong> ' || author || '</p>'] ELSE [] END, ['  </header>', {main}])"
    section = f"""'    <section class="page" data-page-index="' || page_index || '">' || {nl} || {page(html)} || {nl} || '    </section>'"""
    ends = f"'  </main>' || {nl} || '</body>' || {nl} || '</html>'"
    book = f"p AS (SELECT doc_id, -1 AS part, {text(begin)} AS body FROM n UNION ALL SELECT doc_id, page_index, {section} FROM b GROUP BY doc_id, page_index UNION ALL SELECT doc_id, 2147483647, {ends} FROM n)"
    frame = quoted('<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8">\n  <meta name="pdfa-compliance" content="PDF/A-2b">\n  <title>') + " || coalesce(nullif(title, ''), 'PDF/A Document') || " + quoted("</title>\n" + E.ARCHIVAL_STYLE + "</head>\n<body>")
    colours = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.COLOURS.items()) + f" ELSE '{E.OTHER_COLOUR}' END"
    whole = lambda x: f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN {x}::INT END"
    number = lambda name: whole(_get("v", name))
    records = f"""{_NUMBERED}, it AS (SELECT rec_id, pp, up, list(coalesce(CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN {_get('v', 'text')} ELSE json_extract_string(v, '$') END, '') ORDER BY pos) AS li FROM l WHERE st = 'part' AND ends_with(p, '.items') GROUP BY 1, 2, 3),
        ce AS (SELECT rec_id, pp, up, list({{'r': {number('rowindex')}, 'c': {number('colindex')}, 'span': greatest(coalesce({number('rowspan')}, 1), coalesce({number('colspan')}, 1)), 't': {_get('v', 'text')}}} ORDER BY pos) AS cs FROM l WHERE st = 'part' AND ends_with(p, '.cells') GROUP BY 1, 2, 3),
        b0 AS (SELECT l.rec_id AS doc_id, (l.top - 1)::INT AS page_index, (len(string_split(l.p, '.')) + CASE WHEN contains(l.p, '^') THEN split_part(l.p, '^', 2)::INT ELSE 1 END) * 1000000 + l.nth AS pos, {_get('v', 'id')} AS block_id, lower(coalesce({_get('v', 'blocktype')}, 'text')) AS k, coalesce({_get('v', 'text')}, '') AS t, coalesce(greatest(1, least(6, {number('level')})), 1) AS lv,
          coalesce(lower({_get('v', 'ordered')}) IN ('true', 't', 'yes', 'y', '1'), false) AS ordered, coalesce(li, []) AS li, NULL::STRUCT(provider VARCHAR, stage VARCHAR) AS pr, {_get('v', 'caption')} AS cap0, {_get('v', 'text')} AS t0, coalesce({_get('v', 'expression')}, {_get('v', 'text')}, '') AS ex, coalesce(cs, []) AS cs, {number('numrows')} AS nr, {number('numcols')} AS nc
          FROM l LEFT JOIN it ON it.rec_id = l.rec_id AND it.pp = l.p AND it.up = l.nth LEFT JOIN ce ON ce.rec_id = l.rec_id AND ce.pp = l.p AND ce.up = l.nth WHERE st = 'block'),
        b1 AS (SELECT *, coalesce(cap0, CASE WHEN k = 'figure' THEN t0 END) AS cap, coalesce(nr, list_max(list_transform(cs, lambda x: x.r + 1)), 0) AS rn, coalesce(nc, list_max(list_transform(cs, lambda x: x.c + 1)), 0) AS cn, len(list_filter(cs, lambda x: x.span > 1)) > 0 AS merged FROM b0),
        b AS (SELECT *, list_transform(range(rn), lambda i: list_transform(range(cn), lambda j: coalesce(list_filter(cs, lambda x: x.r = i AND x.c = j)[-1].t, ''))) AS grid FROM b1)"""
    of_records = " UNION ALL ".join(f"SELECT '{name}' AS format, doc_id, page_index AS part, string_agg(body, {nl} ORDER BY pos, body) AS body FROM (SELECT *, {text(x)} AS body FROM b) GROUP BY doc_id, page_index" for name, x in (("markdown", md), ("html", html), ("text", txt)))
    return {
        "export_records": f"WITH RECURSIVE {records}, z AS ({of_records}) SELECT format, doc_id, part, {done} FROM z",
        "export_markdown": f"WITH {_BLOCKS}, {_FILES}, p AS (SELECT doc_id, -1 AS part, {text(about)} AS body FROM n UNION ALL SELECT doc_id, page_index, {page(md)} FROM b GROUP BY 1, 2) SELECT doc_id, part, {done} FROM p",
        "export_html": f"WITH {_BLOCKS}, {_FILES}, {book} SELECT doc_id, part, {done} FROM p",
        "export_text": f"WITH {_BLOCKS}, {_FILES}, p AS (SELECT doc_id, -1 AS part, 'DOCUMENT: ' || {title} || {nl} || repeat('=', 40) || {nl} AS body FROM n UNION ALL SELECT doc_id, page_index, '--- Page ' || (page_index + 1) || ' ---' || {nl} || {page(txt)} FROM b GROUP BY doc_id, page_index) SELECT doc_id, part, {done} FROM p",
        "export_warnings": f"WITH {_BLOCKS} SELECT doc_id, block_id, 'Raster image block ''' || block_id || ''' replaced with text placeholder.' AS warning FROM b WHERE k = 'figure'",
        "export_json": "SELECT DISTINCT block_uid, doc_id, page_index, pos, block_id, block_type, text, heading_level, coalesce(len(list_items), 0)::INT AS n_items FROM blocks",
        "rag_chunks": f"WITH {_CHUNKS}, d AS (SELECT *, count_if(k = 'heading') OVER (PARTITION BY doc_id ORDER BY page_index, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_headings FROM c) SELECT {_CHUNK_ID}, page_index, {_CHUNK_TYPE}, ct AS text, n_headings::BIGINT AS n_headings, round(bbox.box_left, 4) AS box_left, CASE WHEN k = 'formula' THEN nullif(t, '') END AS formula_latex FROM d WHERE ct <> ''",
        "rag_hierarchy": f"WITH {_CHUNKS}, d AS (SELECT *, list_filter(list(CASE WHEN k = 'heading' THEN ct END) OVER (PARTITION BY doc_id ORDER BY page_index, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS hh FROM c) SELECT {_CHUNK_ID}, len(hh)::INT AS n_headings, md5(coalesce(array_to_string(hh, '|'), '')) AS headings FROM d WHERE ct <> ''",
        "rag_nested": f"WITH {_CHUNKS}, z AS (SELECT *, page_index * 100000 + pos AS o, CASE WHEN k = 'heading' AND ct <> '' THEN coalesce(heading_level, 1) END AS hl FROM c), x AS (SELECT *, {_LEVELS} FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT {_CHUNK_ID}, {_CHUNK_TYPE}, coalesce(array_to_string(list_filter([{_PATH}], lambda y: y IS NOT NULL), ' > '), '') AS path FROM x WHERE ct <> ''",
        "vector_records": "WITH c AS (SELECT DISTINCT chunk_uid, page_index, text, doc_id, document_name, bbox, figure_caption FROM chunks) SELECT chunk_uid, kind, md5(text) AS text_digest, page_index, doc_id::VARCHAR AS document_id, document_name, round(bbox[1], 4) AS box_left, md5(figure_caption) AS caption_digest FROM c, (VALUES ('langchain'), ('llamaindex'), ('qdrant'), ('pinecone'), ('chroma')) v(kind)",
        "table_markdown": "WITH l AS (SELECT *, max(r) OVER (PARTITION BY table_id) = 2 AS span FROM (SELECT l_orderkey AS table_id, l_linenumber - 1 AS r, max(l_partkey)::VARCHAR AS a, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)), m AS (SELECT table_id, span, max(r) AS r, min(r) AS lo FROM l GROUP BY 1, 2), g AS (SELECT m.table_id, m.span, x.r, coalesce(a, '') AS a, coalesce(f, '') AS f FROM m, LATERAL (SELECT unnest(range(m.r + 1)) AS r) x LEFT JOIN l ON l.table_id = m.table_id AND l.r = x.r), s AS (SELECT table_id, span, r, CASE WHEN span THEN '    <tr>' || chr(10) || '      <td>' || a || '</td>' || chr(10) || '      <td>' || f || '</td>' || chr(10) || '    </tr>' WHEN r = 0 THEN '| ' || a || ' | ' || f || ' |' || chr(10) || '| --- | --- |' ELSE '| ' || a || ' | ' || f || ' |' END AS x FROM g) SELECT table_id, CASE WHEN span THEN '<table>' || chr(10) || '  <tbody>' || chr(10) || string_agg(x, chr(10) ORDER BY r) || chr(10) || '  </tbody>' || chr(10) || '</table>' ELSE string_agg(x, chr(10) ORDER BY r) END AS body FROM s GROUP BY table_id, span",
        "overlay": f"WITH b AS (SELECT DISTINCT block_uid, doc_id, page_index, lower(block_type) AS type, bbox.box_left AS l, coalesce(text, '') AS t FROM blocks WHERE bbox IS NOT NULL), g AS (SELECT doc_id, page_index, max(width) AS width, max(height) AS height FROM raw_pages GROUP BY 1, 2) SELECT block_uid, type, {colours} AS color, 0.95::DOUBLE AS confidence, round(l, 4) AS box_left, substr(t, 1, 100) AS text, width, height FROM b LEFT JOIN g USING (doc_id, page_index)",
        "figure_assets": f"WITH {_BLOCKS} SELECT block_uid, CASE WHEN block_uid % 2 = 0 THEN 'data:image/png;base64,' || base64(encode(block_id)) ELSE {missing} END AS uri, CASE WHEN block_uid % 2 <> 0 THEN 'Image asset ''' || block_id || ''' has no binary content.' END AS warning, CASE WHEN block_uid % 2 = 0 THEN 'assets/' || block_id || '.png' END AS path FROM b WHERE k = 'figure'",
        "binary_exports": "SELECT DISTINCT doc_id, page_index AS part, kind, true AS is_zip FROM blocks, (VALUES ('docx'), ('epub')) v(kind)",
        "archival_export": f"WITH {_BLOCKS}, {_FILES}, {book} SELECT p.doc_id, part, octet_length(encode(CASE part WHEN -1 THEN {frame} || body WHEN 2147483647 THEN body || '</body>' || {nl} || '</html>' ELSE body END))::INT AS n_bytes FROM p LEFT JOIN n USING (doc_id)",
    }
