"""Queries over boxes on pages: geometry, classes, neighbours, order and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions.tables import once, table
from pagewright.operators import layout as L
from pagewright.sources.files import polygon_regions as polygons
from pagewright.sources.files import region_text


def _all(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Blocks once each (of one type, if it is given), with their page's size where it is known."""
    b = table(spark, sf_dir, "blocks")
    b = (b if kind is None else b.where(F.lower("block_type") == kind)).select("block_uid", "doc_id", "page_index", "pos", "block_id", "block_type", "text", "heading_level", *[F.col(f"bbox.box_{x}").alias(x) for x in L.BOX], F.coalesce("bbox.is_normalized", F.lit(True)).alias("is_normalized"), F.col("bbox").isNotNull().alias("has_box"))
    p = table(spark, sf_dir, "raw_pages").groupBy("doc_id", "page_index").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("rotation").alias("rotation"))
    return once(b, "block_uid").join(p, L.PAGE, "left")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).where("has_box")


_RAW = """every AS (SELECT b.*, p.width, p.height, p.rotation FROM (SELECT DISTINCT block_uid, doc_id, page_index, pos, block_id, block_type, text, heading_level, bbox.box_left AS l, bbox.box_top AS t, bbox.box_right AS r, bbox.box_bottom AS b, coalesce(bbox.is_normalized, true) AS is_normalized, bbox IS NOT NULL AS has_box FROM blocks) b
    LEFT JOIN (SELECT doc_id, page_index, max(width) AS width, max(height) AS height, max(rotation) AS rotation FROM raw_pages GROUP BY 1, 2) p USING (doc_id, page_index)),
    raw AS (SELECT * FROM every WHERE has_box)"""


def _placed(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """All blocks; boxes in thousandths of the page, as whole numbers over 1000, so that sums don't depend on how they are
    made; null for blocks without one."""
    r = _all(spark, sf_dir, kind)
    c = [F.col(x) for x in L.BOX]
    pdf = G.from_pdf(c[0], F.least(c[1], c[3]), c[2], F.greatest(c[1], c[3]), F.coalesce("width", F.lit(612.0)), F.coalesce("height", F.lit(792.0)), F.lit(0))
    plain = G.normalized(*c)
    milli = [F.floor(F.when(F.col("is_normalized"), a).otherwise(b) * 1000 + 0.5) / 1000.0 for a, b in zip(plain, pdf, strict=True)]
    return r.select("block_uid", *L.PAGE, "pos", "block_id", "block_type", "text", "heading_level", "has_box", *[F.when(F.col("has_box"), m).alias(x) for m, x in zip(milli, L.BOX, strict=True)])


def _boxes(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Blocks with a box."""
    return _placed(spark, sf_dir, kind).where("has_box").drop("has_box")


_CL = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"


def _milli(a: str, b: str, c: str, d: str, f: str) -> str:
    """least or greatest (f) of the clamped plain sides a, b or the PDF sides c, d."""
    return f"floor((CASE WHEN is_normalized THEN round({f}({_CL.format(a)}, {_CL.format(b)}), 5) ELSE round({f}({_CL.format(c)}, {_CL.format(d)}), 5) END) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE"


_BOXES = f"""{_RAW}, sized AS (SELECT * REPLACE (coalesce(width, 612.0) AS width, coalesce(height, 792.0) AS height) FROM every),
    placed0 AS (SELECT block_uid, doc_id, page_index, pos, block_id, block_type, text, heading_level, has_box, {_milli('l', 'r', 'l / width', 'r / width', 'least')} AS bl,
      {_milli('t', 'b', '(1 - greatest(t, b) / height)', '(1 - least(t, b) / height)', 'least')} AS bt, {_milli('l', 'r', 'l / width', 'r / width', 'greatest')} AS br,
      {_milli('t', 'b', '(1 - greatest(t, b) / height)', '(1 - least(t, b) / height)', 'greatest')} AS bb FROM sized),
    placed AS (SELECT * REPLACE (CASE WHEN has_box THEN bl END AS bl, CASE WHEN has_box THEN bt END AS bt, CASE WHEN has_box THEN br END AS br, CASE WHEN has_box THEN bb END AS bb) FROM placed0),
    boxes AS (SELECT * FROM placed WHERE has_box)"""


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("block_uid", *[F.col(x).alias(f"box_{x}") for x in L.BOX])


def rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in points, turned as their page is."""
    r = _raw(spark, sf_dir).where("not is_normalized and width > 0 and height > 0")
    b = G.from_pdf(F.col("left"), F.least("top", "bottom"), F.col("right"), F.greatest("top", "bottom"), F.col("width"), F.col("height"), F.col("rotation"))
    return r.select("block_uid", *[F.round(x, 3).alias(f"box_{n}") for x, n in zip(b, L.BOX, strict=True)])


def invalid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _raw(spark, sf_dir)
    return r.where(~G.is_valid(*[F.col(x) for x in L.BOX], F.col("is_normalized"))).select("block_uid", "block_type")


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _placed(spark, sf_dir)
    b = b.withColumn("c", L.semantic_class(F.col("text"), F.col("block_type"), F.col("top"), F.col("bottom"), F.col("has_box"))).withColumn("kind", L.retyped(F.col("block_type"), F.col("c.category")))
    was_text = (F.col("kind") == "heading") & (F.lower("block_type") == "text")
    return b.withColumn("retyped_level", F.when(was_text, L.heading_level(F.col("text"))))


def semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).select("block_uid", "c.category", "c.confidence", F.col("kind").alias("retyped"), "retyped_level")


_SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_C = r"\p{Lu}\p{Ll}\p{Lt}"
_TITLE = rf"(regexp_matches(t, '[{_C}]') AND NOT regexp_matches(t, '(^|[^{_C}])\p{{Ll}}') AND NOT regexp_matches(t, '[{_C}][\p{{Lu}}\p{{Lt}}]'))"
_UPPER = r"(regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]'))"
_CLASSED = rf"""{_BOXES}, tx AS (SELECT *, regexp_replace(text, '^{_SP}+|{_SP}+$', '', 'g') AS t FROM placed),
    ty AS (SELECT *, len(list_filter(regexp_split_to_array(t, '{_SP}+'), lambda w: w <> '')) AS words, length(t) < 120 AND NOT contains(t, chr(10)) AS short, {_TITLE} AS ti, {_UPPER} AS up FROM tx),
    cl AS (SELECT *, CASE WHEN coalesce(t, '') = '' THEN 'UNKNOWN|0.0' WHEN has_box AND regexp_matches(t, '{L.PAGE_NUMBER}') AND (bt < 0.10 OR bb > 0.90) THEN 'PAGE_NUMBER|0.95' WHEN has_box AND regexp_matches(t, '{L.PAGE_NUMBER}') THEN 'PAGE_NUMBER|0.8'
      WHEN bt < 0.06 THEN 'HEADER|0.85' WHEN bb > 0.94 THEN 'FOOTER|0.85' WHEN lower(block_type) = 'heading' THEN 'HEADING|0.98' WHEN starts_with(t, '#') THEN 'HEADING|0.92'
      WHEN short AND regexp_matches(t, '{L.NAMED_SECTION}') THEN 'HEADING|0.9' WHEN short AND regexp_matches(t, '{L.NUMBERED}') THEN 'HEADING|0.85'
      WHEN short AND ti AND NOT regexp_matches(t, '[.,;:]$') AND length(t) > 3 AND words <= 8 THEN 'HEADING|0.7' WHEN short AND up AND length(t) > 3 AND words <= 8 THEN 'HEADING|0.75'
      WHEN regexp_matches(t, '{L.BULLET}') THEN 'LIST|0.9' WHEN regexp_matches(t, '{L.CAPTION}') THEN 'CAPTION|0.95' ELSE 'PARAGRAPH|0.75' END AS c FROM ty),
    ct AS (SELECT *, split_part(c, '|', 1) AS category, split_part(c, '|', 2)::DOUBLE AS confidence FROM cl),
    k AS (SELECT *, CASE WHEN lower(block_type) <> 'text' THEN lower(block_type) WHEN category = 'HEADING' THEN 'heading' ELSE 'paragraph' END AS retyped FROM ct),
    rl AS (SELECT *, CASE WHEN retyped = 'heading' AND lower(block_type) = 'text' THEN CASE WHEN regexp_matches(t, '{L.NAMED_PREFIX}') THEN 1 WHEN regexp_matches(t, '^\d+\.\d+\.\d+') THEN 3 WHEN regexp_matches(t, '^\d+\.\d+') THEN 2 WHEN (ti OR up) AND length(t) > 3 THEN 2 ELSE 1 END END::INT AS retyped_level FROM k)"""
_CLASSES_SQL = f"WITH {_CLASSED} SELECT block_uid, category, confidence, retyped, retyped_level FROM rl"


def spatial_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.spatial_edges(_boxes(spark, sf_dir))


_EDGES = f"""{_BOXES}, pr AS (SELECT a.doc_id, a.page_index, a.block_id AS ia, b.block_id AS ib, b.bt - a.bb AS dy, b.bl - a.br AS dx FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.pos < b.pos),
    re AS (SELECT *, CASE WHEN dy >= -0.01 THEN 'BELOW' WHEN dx >= -0.01 THEN 'RIGHT_OF' END AS rel, round(greatest(0.0::DOUBLE, CASE WHEN dy >= -0.01 THEN dy ELSE dx END), 5) AS distance FROM pr),
    edges AS (SELECT doc_id, page_index, ia AS from_id, ib AS to_id, rel AS relation, distance FROM re WHERE rel IS NOT NULL UNION ALL SELECT doc_id, page_index, ib, ia, CASE rel WHEN 'BELOW' THEN 'ABOVE' ELSE 'LEFT_OF' END, distance FROM re WHERE rel IS NOT NULL)"""


def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return L.neighbours(L.spatial_edges(b), b, "BELOW").groupBy(F.lower("to_type").alias("to_type")).agg(F.count("*").alias("edges"))


def caption_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _classed(spark, sf_dir).where("has_box")
    return L.assigned_captions(L.spatial_edges(b), b, F.col("c.category") == "CAPTION")


def caption_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_captions(_boxes(spark, sf_dir))


def caption_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_captions(_boxes(spark, sf_dir), strict=True, by_distance=False).drop("distance")


_NEAR = f"""{_BOXES}, nr AS (SELECT f.doc_id, f.page_index, f.block_id, c.block_id AS caption_id, c.pos AS cap_pos, round(least(abs(c.bt - f.bb), abs(f.bt - c.bb)), 6) AS distance FROM boxes f JOIN boxes c ON f.doc_id = c.doc_id AND f.page_index = c.page_index AND lower(f.block_type) IN ('figure', 'table') AND lower(c.block_type) = 'caption')"""


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _classed(spark, sf_dir)
    level = F.when(F.lower("block_type") == "heading", F.col("heading_level")).otherwise(F.col("retyped_level"))
    return L.sections(b, (F.col("c.category") == "HEADING") | (F.lower("block_type") == "heading"), F.coalesce(level, F.lit(1)))


def doc_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").select("doc_id", "page_index", "pos", "block_id", F.when(F.lower("block_type") == "heading", F.coalesce("heading_level", F.lit(1))).alias("heading_level")).distinct()
    return L.hierarchy(b)


_HIER = """WITH b AS (SELECT DISTINCT doc_id, page_index, pos, block_id, CASE WHEN lower(block_type) = 'heading' THEN coalesce(heading_level, 1) END AS lv FROM blocks),
    s AS (SELECT *, lv IS NOT NULL AS h, count_if(lv IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY page_index, pos) AS seen FROM b), t AS (SELECT *, h AND (lv = 1 OR seen = 1) AS top FROM s),
    u AS (SELECT *, count_if(top) OVER (PARTITION BY doc_id ORDER BY page_index, pos) AS sec FROM t), v AS (SELECT *, count_if(h AND NOT top) OVER (PARTITION BY doc_id, sec ORDER BY page_index, pos) AS sub FROM u)
    SELECT doc_id, block_id, CASE WHEN sec = 0 THEN 'section_root' WHEN sub > 0 THEN 'section_' || sec || '_' || sub ELSE 'section_' || sec END AS node_id, CASE WHEN sec = 0 THEN 'root' WHEN sub > 0 THEN 'section_' || sec ELSE 'root' END AS parent_id, CASE WHEN top THEN 1 WHEN h THEN lv END::INT AS node_level FROM v"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(_boxes(spark, sf_dir))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    i = L.order_items(L.reading_order(b), b, L.nearest_captions(b, strict=True, by_distance=False))
    return i.select(*L.PAGE, "block_id", "category", F.col("metadata")["top"].cast("double").alias("top"), F.col("metadata")["left"].cast("double").alias("left"), F.col("metadata")["associated_caption"].alias("caption"))


def plain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without a box come first."""
    return L.plain_order(_placed(spark, sf_dir).fillna(0.0, ["top", "left"]))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of each document as lines of a page in points: 14 high, some set apart, some indented."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    page, row = F.floor(F.col("i") / 30).cast("int"), F.col("i") % 30
    left = F.when(F.col("i") % 11 == 5, 120.0).otherwise(60.0)
    top = F.lit(780.0) - row * 20.0 - F.when(row >= 12, 40.0).otherwise(0.0)
    return d.select("doc_id", page.alias("page_index"), row.alias("seq"), "text", left.alias("left"), (top - 14.0).alias("bottom"), (left + 400.0).alias("right"), top.alias("top"))


def line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.merged_lines(_lines(spark, sf_dir))
    return m.select("doc_id", "page_index", F.col("block").cast("int").alias("block"), F.length("text").alias("n_chars"), F.col("bottom").alias("low"), F.col("top").alias("high"))


_MERGED = rf"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
    l1 AS (SELECT doc_id, (i // 30)::INT AS page_index, i % 30 AS seq0, regexp_replace(text, '^{_SP}+|{_SP}+$', '', 'g') AS x, CASE WHEN i % 11 = 5 THEN 120.0::DOUBLE ELSE 60.0::DOUBLE END AS lf, 780.0::DOUBLE - (i % 30) * 20.0::DOUBLE - CASE WHEN i % 30 >= 12 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS tp FROM l0),
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY seq0) - 1 AS seq FROM l1 WHERE x <> ''),
    f AS (SELECT doc_id, page_index, seq, 0 AS block, x AS t, lf, tp - 14.0 AS lo, tp AS hi FROM l WHERE seq = 0
      UNION ALL SELECT z.doc_id, z.page_index, z.seq, CASE WHEN j THEN block ELSE block + 1 END, CASE WHEN j THEN t || ' ' || x ELSE x END, CASE WHEN j THEN least(pl, lf) ELSE lf END, CASE WHEN j THEN least(lo, tp - 14.0) ELSE tp - 14.0 END, CASE WHEN j THEN greatest(hi, tp) ELSE tp END
      FROM (SELECT n.*, f.block, f.t, f.lo, f.hi, f.lf AS pl, f.lo - n.tp >= -10 AND f.lo - n.tp <= 25 AND abs(f.lf - n.lf) <= 30
        AND NOT (length(f.t) < 100 AND (regexp_matches(f.t, '{L.NUMBERED}') OR regexp_matches(f.t, '{L.NAMED_SECTION}')
          OR (length(f.t) > 3 AND regexp_matches(f.t, '\p{{Lu}}') AND NOT regexp_matches(f.t, '[\p{{Ll}}\p{{Lt}}]') AND len(list_filter(regexp_split_to_array(f.t, '{_SP}+'), lambda w: w <> '')) <= 6))) AS j
        FROM f JOIN l n ON f.doc_id = n.doc_id AND f.page_index = n.page_index AND n.seq = f.seq + 1) z),
    m AS (SELECT doc_id, page_index, block, max(length(t))::INT AS n_chars, min(lo) AS low, max(hi) AS high FROM f GROUP BY 1, 2, 3)"""
_MERGE = f"WITH RECURSIVE {_MERGED} SELECT * FROM m"


def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines merged and assembled, with an image on every third page."""
    m = L.merged_lines(_lines(spark, sf_dir)).withColumn("block", F.col("block").cast("int"))
    images = m.select(*L.PAGE).where("page_index % 3 = 0").distinct().withColumn("image_index", F.lit(0))
    return L.assembled(m, images).select("doc_id", "page_index", "block_id", "block_type", F.length("text").alias("n_chars"), "reading_order_index")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).where("lower(block_type) = 'table'").select(F.col("block_uid").alias("table_id"), *L.BOX)


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = L.grid_cells(_tables(spark, sf_dir))
    return g.select("table_id", "row_index", "col_index", "is_header", *[F.round(x, 3).alias(f"cell_{x}") for x in L.BOX])


def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a table's page that lie in its cells."""
    b = _boxes(spark, sf_dir)
    tabs = b.where("lower(block_type) = 'table'").select(*L.PAGE, F.col("block_uid").alias("table_id"), *[F.col(x).alias(f"t_{x}") for x in L.BOX])
    whole = tabs.select("table_id", F.lit("c").alias("cell_id"), F.lit(0).alias("pos"), F.lit("").alias("text"), *[F.col(f"t_{x}").alias(x) for x in L.BOX])
    right = whole.withColumn("cell_id", F.lit("d")).withColumn("pos", F.lit(1)).withColumn("left", (F.col("left") + F.col("right")) / 2)
    texts = b.where("text is not null").join(tabs.select(*L.PAGE, "table_id"), L.PAGE).select("table_id", F.col("block_uid").alias("text_id"), "text", *L.BOX)
    return L.cell_texts(whole.unionByName(right), texts).select("table_id", "cell_id", "text")


_CELL = f"""WITH {_BOXES}, ta AS (SELECT doc_id, page_index, block_uid AS table_id, bl, bt, br, bb FROM boxes WHERE lower(block_type) = 'table'),
    ce AS (SELECT table_id, 'c' AS cell_id, 0 AS pos, bl, bt, br, bb FROM ta UNION ALL SELECT table_id, 'd', 1, (bl + br) / 2, bt, br, bb FROM ta),
    te AS (SELECT table_id, block_uid AS text_id, text, b.bl, b.bt, b.br, b.bb FROM boxes b JOIN ta USING (doc_id, page_index) WHERE text IS NOT NULL),
    sh AS (SELECT te.*, cell_id, pos, round(greatest(0.0::DOUBLE, least(ce.br, te.br) - greatest(ce.bl, te.bl)) * greatest(0.0::DOUBLE, least(ce.bb, te.bb) - greatest(ce.bt, te.bt)) / greatest(greatest(0.0::DOUBLE, te.br - te.bl) * greatest(0.0::DOUBLE, te.bb - te.bt), 1e-6::DOUBLE), 6) AS share FROM te JOIN ce USING (table_id)),
    be AS (SELECT * FROM sh WHERE share >= 0.3 QUALIFY row_number() OVER (PARTITION BY table_id, text_id ORDER BY share DESC, pos) = 1),
    jo AS (SELECT table_id, cell_id, string_agg(text, ' ' ORDER BY bt, bl, text_id) AS found FROM be GROUP BY 1, 2)
    SELECT table_id, cell_id, coalesce(found, '') AS text FROM ce LEFT JOIN jo USING (table_id, cell_id)"""


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of detected regions by number, and the blocks they become."""
    b = _boxes(spark, sf_dir).select("block_uid", (F.col("block_uid") % 13).alias("label"))
    cat = L.label_category(F.col("label"))
    kind, level = L.region_block_type(F.col("category"))
    return b.withColumn("category", cat).select("block_uid", "category", kind.alias("kind"), level.alias("level"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as regions that a model might have found."""
    b = _boxes(spark, sf_dir).withColumn("confidence", (F.col("block_uid") % 100) / 100.0)
    return b.select("doc_id", "page_index", F.col("pos").alias("region_idx"), "text", L.label_category(F.lower("block_type")).alias("category"), *L.BOX, "confidence")


def region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.region_blocks(_regions(spark, sf_dir), "rtdetr_layout", "rtdetr_doclaynet")
    return r.select(*L.PAGE, "block_id", "block_type", "heading_level", F.col("provenance.confidence").alias("confidence"), F.col("provenance.stage").alias("stage"))


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.ocr_blocks(_regions(spark, sf_dir).where("text is not null"), "rapidocr", "rapidocr_onnx")
    return r.select(*L.PAGE, "block_id", F.md5("text").alias("digest"), "reading_order_index", F.col("provenance.confidence").alias("confidence"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a box as an OCR engine finds them: four corners in pixels, a page of 1000 by 1000 each."""
    corner = lambda x, y: F.struct((F.col(x) * 1000 + (F.col("block_uid") % 3) * 40).alias("x"), (F.col(y) * 1000).alias("y"))
    found = F.struct("pos", F.array(corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom")).alias("points"), F.col("text").alias("text"), ((F.col("block_uid") % 100) / 100.0).alias("confidence"))
    b = _boxes(spark, sf_dir).where("text is not null").groupBy(F.concat_ws("/", "doc_id", "page_index").alias("image_id")).agg(F.array_sort(F.collect_list(found)).alias("found"))
    return b.withColumns({"width": F.lit(1000), "height": F.lit(1000)})


def polygon_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = polygons(_found(spark, sf_dir))
    return r.select("image_id", "region_idx", F.md5("text").alias("digest"), "confidence", *[F.round(x, 3).alias(f"box_{x}") for x in L.BOX])


def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_text(polygons(_found(spark, sf_dir))).select("image_id", F.md5("full_text").alias("digest"))


def fallback_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fallback_regions(table(spark, sf_dir, "raw_pages").select(*L.PAGE).distinct(), 0.93)


def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with the cells of a uniform grid."""
    t = _tables(spark, sf_dir)
    cells = L.grid_cells(t).select("table_id", F.concat("row_index", F.lit("-"), "col_index").alias("cell_id"), "row_index", "col_index", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("").alias("text"), "is_header")
    tables = _boxes(spark, sf_dir).where("lower(block_type) = 'table'").select(*L.PAGE, F.col("block_uid").alias("table_id"), F.lit(2).alias("num_rows"), F.lit(2).alias("num_cols"), F.lit(0.9).alias("confidence"))
    b = L.table_blocks(tables, cells, "slanet_table", "slanet_v1")
    return b.select(*L.PAGE, "block_id", F.size("cells").alias("n_cells"), F.array_join(F.transform("cells", lambda c: c["cell_id"]), ",").alias("cell_ids"))


def result_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with the caption nearest to them, and formulas of three formats, as blocks."""
    b = _boxes(spark, sf_dir)
    near = L.nearest_captions(b).select(*L.PAGE, "block_id", "caption_id")
    f = b.where("lower(block_type) = 'figure'").join(near, [*L.PAGE, "block_id"], "left").select(*L.PAGE, F.col("block_id").alias("figure_id"), F.col("caption_id").alias("caption"), F.lit("").alias("description"), F.lit(1.0).alias("confidence"))
    m = b.where("lower(block_type) = 'formula'").select(*L.PAGE, F.col("block_id").alias("formula_id"), F.coalesce("text", F.lit("x")).alias("value"), F.element_at(F.array(F.lit("latex"), F.lit("plaintext"), F.lit("mathml")), (F.col("block_uid") % 3 + 1).cast("int")).alias("format"), F.when(F.col("block_uid") % 2 == 0, "inline").otherwise("display").alias("kind"), F.lit(1.0).alias("confidence"))
    figs = L.figure_blocks(f, "local_figure_analyzer", "basic_figure_v1").select(*L.PAGE, "block_id", "block_type", F.col("caption").alias("content"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("boolean").alias("is_inline"))
    return figs.unionByName(L.formula_blocks(m, "local_formula_recognizer", "texify_v1").select(*L.PAGE, "block_id", "block_type", F.col("expression").alias("content"), "format", "is_inline"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with scores, those below the threshold dropped; pixels and shares are told apart by their size."""
    r = _boxes(spark, sf_dir).withColumn("score", (F.col("block_uid") % 100) / 100.0).where("score >= 0.5")
    px = F.when(F.col("block_uid") % 2 == 0, 1000.0).otherwise(1.0)
    b = G.normalized(*[F.col(x) * px for x in ("right", "top", "left", "bottom")], F.lit(1000.0), F.lit(1000.0))
    return r.select("block_uid", "score", *[F.round(x, 3).alias(f"box_{n}") for x, n in zip(b, L.BOX, strict=True)])


def figure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).where("lower(block_type) = 'figure' and bottom > top")
    aspect = F.round((F.col("right") - F.col("left")) / (F.col("bottom") - F.col("top")), 2)
    return b.select("block_uid", L.figure_class(F.when(F.col("block_uid") % 3 == 0, "image/jpeg").otherwise("image/png"), aspect).alias("figure_class"), aspect.alias("aspect"))


def equation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("chunk_type = 'formula'").select("chunk_uid", "text").distinct()
    numbered = F.concat(F.trim("text"), F.lit(" ("), (F.col("chunk_uid") % 40).cast("string"), F.lit(".1)"))
    return c.select("chunk_uid", L.equation_number(F.when(F.col("chunk_uid") % 2 == 0, numbered).otherwise(F.col("text"))).alias("number"))


def queries() -> dict:
    return {
        "page_boxes": page_boxes, "rotated_boxes": rotated_boxes, "invalid_boxes": invalid_boxes, "semantic_classes": semantic_classes, "spatial_edges": spatial_edges, "neighbour_counts": neighbour_counts,
        "caption_assign": caption_assign, "caption_nearest": caption_nearest, "caption_probe": caption_probe, "page_sections": page_sections, "doc_hierarchy": doc_hierarchy, "reading_order": reading_order, "plain_order": plain_order,
        "order_items": order_items, "pdf_blocks": pdf_blocks, "region_blocks": region_blocks, "ocr_blocks": ocr_blocks, "polygon_regions": polygon_regions, "region_texts": region_texts, "fallback_regions": fallback_regions, "table_blocks": table_blocks, "result_blocks": result_blocks,
        "line_merge": line_merge, "grid_cells": grid_cells, "cell_text": cell_text, "region_labels": region_labels, "detections": detections, "figure_classes": figure_classes, "equation_numbers": equation_numbers,
    }


def oracle_sql() -> dict[str, str]:
    labels = "CASE block_uid % 13 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in L.DOCLAYNET.items() if isinstance(i, int)) + " ELSE 'UNKNOWN' END"
    by_name = "CASE lower(block_type) " + " ".join(f"WHEN '{i}' THEN '{n}'" for i, n in L.DOCLAYNET.items() if isinstance(i, str)) + " ELSE 'UNKNOWN' END"
    kind = "CASE WHEN category IN ('TITLE', 'HEADER') THEN 'heading' WHEN category IN ('LIST', 'TABLE', 'FIGURE', 'FORMULA', 'CAPTION') THEN lower(category) ELSE 'paragraph' END"
    level = "CASE category WHEN 'TITLE' THEN 1 WHEN 'HEADER' THEN 2 END::INT"
    near = "SELECT doc_id, page_index, block_id, caption_id FROM nr WHERE distance < 0.08 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, block_id ORDER BY cap_pos) = 1"
    nearest = "SELECT doc_id, page_index, block_id, caption_id FROM nr WHERE distance <= 0.08 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, block_id ORDER BY distance, cap_pos) = 1"
    turn = "CASE rotation WHEN 90 THEN {} WHEN 180 THEN {} WHEN 270 THEN {} ELSE {} END"
    x1, x2 = turn.format("lo / height", "1 - r / width", "1 - hi / height", "l / width"), turn.format("hi / height", "1 - l / width", "1 - lo / height", "r / width")
    y1, y2 = turn.format("l / width", "lo / height", "1 - r / width", "1 - hi / height"), turn.format("r / width", "hi / height", "1 - l / width", "1 - lo / height")
    side = lambda f, a, b: f"round(round({f}({_CL.format(a)}, {_CL.format(b)}), 5), 3)"
    px = lambda f, a, b: f"round(round({f}({_CL.format(a)}, {_CL.format(b)}), 5), 3)"
    return {
        "page_boxes": f"WITH {_BOXES} SELECT block_uid, bl AS box_left, bt AS box_top, br AS box_right, bb AS box_bottom FROM boxes",
        "rotated_boxes": f"WITH {_RAW}, q AS (SELECT *, least(t, b) AS lo, greatest(t, b) AS hi FROM raw WHERE NOT is_normalized AND width > 0 AND height > 0) SELECT block_uid, {side('least', x1, x2)} AS box_left, {side('least', y1, y2)} AS box_top, {side('greatest', x1, x2)} AS box_right, {side('greatest', y1, y2)} AS box_bottom FROM q",
        "invalid_boxes": f"WITH {_RAW} SELECT block_uid, block_type FROM raw WHERE NOT (l <= r AND t <= b AND (NOT is_normalized OR (l BETWEEN -1e-4 AND 1 + 1e-4 AND t BETWEEN -1e-4 AND 1 + 1e-4 AND r BETWEEN -1e-4 AND 1 + 1e-4 AND b BETWEEN -1e-4 AND 1 + 1e-4)))",
        "semantic_classes": _CLASSES_SQL,
        "spatial_edges": f"WITH {_EDGES} SELECT * FROM edges",
        "neighbour_counts": f"WITH {_EDGES} SELECT lower(block_type) AS to_type, count(*) AS edges FROM edges e JOIN boxes b ON e.doc_id = b.doc_id AND e.page_index = b.page_index AND e.to_id = b.block_id WHERE relation = 'BELOW' GROUP BY 1",
        "caption_assign": f"WITH {_EDGES.replace(_BOXES, _CLASSED)} SELECT e.doc_id, e.page_index, e.to_id AS block_id, arg_max(c.text, c.pos) AS caption FROM edges e JOIN rl c ON e.doc_id = c.doc_id AND e.page_index = c.page_index AND e.from_id = c.block_id AND c.category = 'CAPTION' AND c.has_box JOIN boxes o ON e.doc_id = o.doc_id AND e.page_index = o.page_index AND e.to_id = o.block_id AND lower(o.block_type) IN ('figure', 'table') GROUP BY 1, 2, 3",
        "caption_nearest": f"WITH {_NEAR} SELECT doc_id, page_index, block_id, caption_id, distance FROM nr WHERE distance <= 0.08 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, block_id ORDER BY distance, cap_pos) = 1",
        "caption_probe": f"WITH {_NEAR} SELECT doc_id, page_index, block_id, caption_id FROM nr WHERE distance < 0.08 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, block_id ORDER BY cap_pos) = 1",
        "page_sections": f"WITH {_CLASSED}, h0 AS (SELECT *, category = 'HEADING' OR lower(block_type) = 'heading' AS h, coalesce(CASE WHEN lower(block_type) = 'heading' THEN heading_level ELSE retyped_level END, 1) AS lv FROM rl), h1 AS (SELECT *, count_if(h) OVER (PARTITION BY doc_id, page_index ORDER BY pos) AS section FROM h0), g AS (SELECT doc_id, page_index, section::INT AS section, max(CASE WHEN h THEN block_id END) AS id, max(CASE WHEN h THEN text END) AS title, max(CASE WHEN h THEN lv END) AS level, coalesce(string_agg(CASE WHEN NOT h THEN block_id END, ',' ORDER BY pos), '') AS blocks FROM h1 GROUP BY 1, 2, 3) SELECT doc_id, page_index, section, CASE WHEN section = 0 THEN 'sec_root' ELSE 'sec_' || id END AS section_id, CASE WHEN section = 0 THEN 'Document Body' ELSE title END AS title, CASE WHEN section = 0 THEN 1 ELSE level END::INT AS level, blocks FROM g",
        "doc_hierarchy": _HIER,
        "reading_order": f"""WITH RECURSIVE {_BOXES}, s AS (SELECT *, greatest(0.01::DOUBLE, br - bl) AS width, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY bl, bt, pos) AS rn FROM boxes),
            f AS (SELECT doc_id, page_index, rn, block_id, bl, bt, [bl] AS lo, [br] AS hi, 1::BIGINT AS c FROM s WHERE rn = 1
              UNION ALL SELECT doc_id, page_index, rn, block_id, bl, bt, CASE WHEN k IS NULL THEN list_append(lo, bl) ELSE list_transform(lo, lambda x, i: CASE WHEN i = k THEN least(x, bl) ELSE x END) END, CASE WHEN k IS NULL THEN list_append(hi, br) ELSE list_transform(hi, lambda x, i: CASE WHEN i = k THEN greatest(x, br) ELSE x END) END, coalesce(k, len(lo) + 1)
              FROM (SELECT n.*, f.lo, f.hi, CASE WHEN n.width < 0.75 THEN list_filter(range(1, len(f.lo) + 1), lambda i: least(n.br, f.hi[i]) - greatest(n.bl, f.lo[i]) > 0.3::DOUBLE * n.width OR abs(n.bl - f.lo[i]) < 0.05::DOUBLE)[1] END AS k FROM f JOIN s n ON n.doc_id = f.doc_id AND n.page_index = f.page_index AND n.rn = f.rn + 1)),
            e AS (SELECT doc_id, page_index, arg_max(lo, rn) AS lo FROM f GROUP BY 1, 2),
            o AS (SELECT f.*, len(list_filter(range(1, len(e.lo) + 1), lambda i: e.lo[i] < e.lo[f.c] OR e.lo[i] = e.lo[f.c] AND i < f.c)) AS col FROM f JOIN e USING (doc_id, page_index))
            SELECT doc_id, page_index, block_id, col::INT AS column_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY col, bt, bl, rn) - 1)::INT AS sequence_index FROM o""",
        "plain_order": f"WITH {_BOXES} SELECT doc_id, page_index, block_id, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY coalesce(bt, 0.0::DOUBLE), coalesce(bl, 0.0::DOUBLE), pos) - 1)::INT AS sequence_index FROM placed",
        "order_items": f"WITH {_NEAR}, ca AS ({near}) SELECT doc_id, page_index, block_id, lower(block_type) AS category, round(bt, 4) AS top, round(bl, 4) AS \"left\", caption_id AS caption FROM boxes LEFT JOIN ca USING (doc_id, page_index, block_id)",
        "pdf_blocks": f"WITH RECURSIVE {_MERGED}, im AS (SELECT DISTINCT doc_id, page_index FROM m WHERE page_index % 3 = 0), u AS (SELECT doc_id, page_index, 0 AS part, block AS i, n_chars FROM m UNION ALL SELECT doc_id, page_index, 1, 0, NULL FROM im) SELECT doc_id, page_index, 'p' || page_index || CASE WHEN part = 0 THEN '-b' ELSE '-fig' END || i AS block_id, CASE WHEN part = 0 THEN 'text' ELSE 'figure' END AS block_type, n_chars, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, part, i) - 1 AS reading_order_index FROM u",
        "region_blocks": f"WITH {_BOXES}, c AS (SELECT *, {by_name} AS category FROM boxes) SELECT doc_id, page_index, 'layout_block_' || pos AS block_id, {kind} AS block_type, {level} AS heading_level, (block_uid % 100) / 100.0::DOUBLE AS confidence, 'LAYOUT_ANALYSIS' AS stage FROM c",
        "ocr_blocks": f"WITH {_BOXES} SELECT doc_id, page_index, 'p' || page_index || '-ocr-' || pos AS block_id, md5(text) AS digest, pos AS reading_order_index, (block_uid % 100) / 100.0::DOUBLE AS confidence FROM boxes WHERE text IS NOT NULL",
        "polygon_regions": f"WITH {_BOXES}, q AS (SELECT doc_id || '/' || page_index AS image_id, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY pos) - 1 AS region_idx, text, (block_uid % 100) / 100.0::DOUBLE AS confidence, bl + (block_uid % 3) * 0.04::DOUBLE AS x, br + (block_uid % 3) * 0.04::DOUBLE AS z, bt, bb FROM boxes WHERE text IS NOT NULL) SELECT image_id, region_idx::INT AS region_idx, md5(text) AS digest, confidence, round({_CL.format('x')}, 3) AS box_left, round({_CL.format('bt')}, 3) AS box_top, round({_CL.format('z')}, 3) AS box_right, round({_CL.format('bb')}, 3) AS box_bottom FROM q WHERE confidence >= 0.5",
        "region_texts": f"WITH {_BOXES} SELECT doc_id || '/' || page_index AS image_id, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM boxes WHERE text IS NOT NULL AND block_uid % 100 >= 50 GROUP BY 1",
        "fallback_regions": "SELECT DISTINCT doc_id, page_index, 0 AS region_idx, 'TITLE' AS category, 0.1::DOUBLE AS \"left\", 0.05::DOUBLE AS top, 0.9::DOUBLE AS \"right\", 0.15::DOUBLE AS bottom, 0.95::DOUBLE AS confidence FROM raw_pages",
        "table_blocks": f"WITH {_BOXES} SELECT doc_id, page_index, block_uid::VARCHAR AS block_id, 4 AS n_cells, '0-0,0-1,1-0,1-1' AS cell_ids FROM boxes WHERE lower(block_type) = 'table'",
        "result_blocks": f"WITH {_NEAR}, ca AS ({nearest}) SELECT doc_id, page_index, block_id, 'figure' AS block_type, caption_id AS content, NULL::VARCHAR AS format, NULL::BOOLEAN AS is_inline FROM boxes LEFT JOIN ca USING (doc_id, page_index, block_id) WHERE lower(block_type) = 'figure' UNION ALL SELECT doc_id, page_index, block_id, 'formula', coalesce(text, 'x'), ['LATEX', 'TEXT', 'MATHML'][(block_uid % 3 + 1)::INT], block_uid % 2 = 0 FROM boxes WHERE lower(block_type) = 'formula'",
        "line_merge": _MERGE,
        "grid_cells": f"WITH {_BOXES}, ta AS (SELECT block_uid AS table_id, bl, bt, br, bb FROM boxes WHERE lower(block_type) = 'table'), g AS (SELECT *, (br - bl) / 2 AS w, (bb - bt) / 2 AS h FROM ta, range(2) r(row_index), range(2) c(col_index)) SELECT table_id, row_index::INT AS row_index, col_index::INT AS col_index, row_index = 0 AS is_header, round(round(bl + col_index * w, 5), 3) AS cell_left, round(round(bt + row_index * h, 5), 3) AS cell_top, round(round(bl + col_index * w + w, 5), 3) AS cell_right, round(round(bt + row_index * h + h, 5), 3) AS cell_bottom FROM g",
        "cell_text": _CELL,
        "region_labels": f"WITH {_BOXES}, c AS (SELECT block_uid, {labels} AS category FROM boxes) SELECT block_uid, category, {kind} AS kind, {level} AS level FROM c",
        "detections": f"WITH {_BOXES}, s AS (SELECT *, (block_uid % 100) / 100.0::DOUBLE AS score FROM boxes) SELECT block_uid, score, {px('least', 'bl', 'br')} AS box_left, {px('least', 'bt', 'bb')} AS box_top, {px('greatest', 'bl', 'br')} AS box_right, {px('greatest', 'bt', 'bb')} AS box_bottom FROM s WHERE score >= 0.5",
        "figure_classes": f"WITH {_BOXES}, a AS (SELECT block_uid, round((br - bl) / (bb - bt), 2) AS aspect FROM boxes WHERE lower(block_type) = 'figure' AND bb > bt) SELECT block_uid, CASE WHEN block_uid % 3 = 0 THEN 'PHOTOGRAPH' WHEN aspect > 3 OR aspect < 0.3 THEN 'DIAGRAM' ELSE 'FIGURE' END AS figure_class, aspect FROM a",
        "equation_numbers": r"WITH c AS (SELECT DISTINCT chunk_uid, text FROM chunks WHERE chunk_type = 'formula') SELECT chunk_uid, nullif(regexp_extract(CASE WHEN chunk_uid % 2 = 0 THEN trim(text) || ' (' || (chunk_uid % 40) || '.1)' ELSE text END, '\((\d+(\.\d+)?)\)', 1), '') AS number FROM c",
    }
