"""Queries over nested document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.scratch import written
from pagewright.functions.tables import table
from pagewright.operators.shred import column, every_table, flat_table, last_name, shred, there

REPEATED = ("pages", "blocks", "children", "items", "cells")


def _rows(spark: SparkSession, sf_dir: str, leaves: list[str] | None, owners: list[str] | None = None) -> DataFrame:
    return written(shred(table(spark, sf_dir, "doc_records"), "pages", REPEATED, leaves, owners), "shredded")


def _own_or_place(own: Column, place: Column) -> Column:
    """A page's own index, else its place."""
    return F.coalesce(F.trim(own).try_cast("int"), place)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (item_pos -1), and list items and cells with their place, linked to page and enclosing block.

    Links are followed within a record before instances become rows: each owner's row meets that of its parent, in
    which an instance is found by its number."""
    rows = _rows(spark, sf_dir, ["id", "pageindex"], ["blocks", "children", "items", "cells"])
    indexes = F.transform(F.arrays_zip(there(column("pageindex")).alias("own"), there(F.col("place")).alias("place")), lambda x: _own_or_place(x["own"], x["place"]))
    pages = rows.where("owner = 'pages'").select("rec_id", indexes.alias("pages"))
    above = rows.where(last_name().isin("blocks", "children")).select("rec_id", F.col("owner").alias("parent"), there(column("id")).alias("parent_ids"))
    mine = rows.where(last_name().isin("blocks", "children")).join(pages, "rec_id").join(above, ["rec_id", "parent"], "left")
    z = F.arrays_zip(there(F.col("top_n")).alias("top"), there(F.col("parent_n")).alias("up"), there(column("id")).alias("id"))
    one = lambda x: F.struct(F.get("pages", x["top"] - 1).alias("page_index"), x["id"].alias("block_id"), F.coalesce(F.get("parent_ids", x["up"] - 1), F.lit("")).alias("parent_id"))
    blocks = mine.select("rec_id", "owner", F.transform(z, one).alias("blocks"))
    whole = blocks.select("rec_id", F.inline("blocks"), F.lit(-1).alias("item_pos"))
    parts = rows.where(last_name().isin("items", "cells")).select("rec_id", F.col("parent").alias("owner"), F.arrays_zip(there(F.col("parent_n")).alias("up"), there(F.col("place")).alias("place")).alias("z"))
    held = lambda x: F.struct(F.get("blocks", x["up"] - 1).alias("b"), x["place"].alias("item_pos"))
    items = parts.join(blocks, ["rec_id", "owner"]).select("rec_id", F.inline(F.transform("z", held))).select("rec_id", "b.page_index", "b.block_id", "b.parent_id", "item_pos")
    return whole.unionByName(items).distinct()


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"width": "width", "height": "height", "rotation": "rotation"}
    p = flat_table(_rows(spark, sf_dir, ["pageindex", *fields], ["pages"]), ["pages"], {"pageindex": "own_index"} | fields)
    return p.withColumn("page_index", _own_or_place(F.col("own_index"), F.col("place"))).select("rec_id", "n", "page_index", "place", *fields.values())


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their boxes. Where some records hold a box as an object and others as an array of its sides, boxes are
    a table of their own, from which each block gets its sides by name or by place."""
    sides = ("left", "top", "right", "bottom")
    fields = {"id": "block_id", "blocktype": "block_type", "text": "text", "caption": "caption", "readingorderindex": "reading_order_index"}
    fields |= {f"bbox.{k}": f"box_{k}" for k in sides} | {"provenance.provider": "provider", "provenance.confidence": "confidence"}
    rows = _rows(spark, sf_dir, [*fields, *sides, "value"], ["blocks", "children", "bbox"])
    blocks = flat_table(rows, ["blocks", "children"], fields)
    parts = flat_table(rows, ["bbox"], {k: k for k in (*sides, "value")})
    named = [F.max(F.coalesce(F.col(k), F.when(F.col("place") == i, F.col("value")))).alias(f"own_{k}") for i, k in enumerate(sides)]
    boxes = parts.groupBy("rec_id", F.col("parent_path").alias("path"), F.col("parent_n").alias("n")).agg(*named)
    both = blocks.join(boxes, ["rec_id", "path", "n"], "left")
    return both.select(*[F.coalesce(f"box_{c[4:]}", f"own_{c[4:]}").alias(c) if c[4:] in sides else c for c in blocks.columns])


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"text": "text", "marker": "marker", "rowindex": "row_index", "colindex": "col_index", "rowspan": "row_span", "colspan": "col_span"}
    return flat_table(_rows(spark, sf_dir, list(fields), ["items", "cells"]), ["items", "cells"], fields)


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of every record: a row for each instance with all its leaves (as JSON, absent ones left out)."""
    r = every_table(_rows(spark, sf_dir, None))
    return r.withColumn("fields", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))))


def p3_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the records' metadata, one a row."""
    rows = every_table(_rows(spark, sf_dir, None, [])).where("path = ''")
    return rows.select("rec_id", F.explode("fields").alias("field", "value")).where("field like 'metadata.%' and value is not null")


def _plain(name: str) -> str:
    return f"lower(regexp_replace({name}, '[^a-zA-Z0-9]', '', 'g'))"


def _member(v: str, name: str) -> str:
    """JSON path of the member of an object by its plain name."""
    return f"('$.\"' || list_filter(json_keys({v}), lambda k: {_plain('k')} = '{name}')[-1] || '\"')"


def _get(v: str, name: str) -> str:
    """A member's plain value as a string."""
    at = _member(v, name)
    return f"CASE WHEN json_type({v}) = 'OBJECT' AND json_type({v}, {at}) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({v}, {at}) END"


_HAS_PAGES = f"len(list_filter(json_keys(n.v), lambda k: {_plain('k')} = 'pages')) > 0"
# Records are walked from their root: wrappers are opened, then pages, blocks and their parts follow; o is the way to a node, by places.
_WALK = f"""n AS (SELECT DISTINCT rec_id, 'top' AS st, payload::JSON AS v, NULL::INT AS page, NULL::VARCHAR AS bid, ''::VARCHAR AS parent, NULL::INT AS pos, ''::VARCHAR AS p, []::INT[] AS o, ''::VARCHAR AS pp, []::INT[] AS po FROM doc_records WHERE json_valid(payload)
  UNION ALL SELECT rec_id, st2, v2, CASE st2 WHEN 'page' THEN CASE WHEN regexp_matches(trim(own), '^[+-]?[0-9]+$') THEN trim(own)::INT ELSE idx END ELSE page END, CASE st2 WHEN 'block' THEN id2 ELSE bid END, CASE WHEN st = 'block' AND st2 = 'blocks' THEN coalesce(bid, '') ELSE parent END, idx,
    CASE WHEN st2 = 'pages' THEN 'pages' WHEN st = 'page' THEN 'pages.blocks' WHEN st = 'block' AND st2 = 'parts' THEN p || '.' || name WHEN st = 'block' THEN CASE WHEN p = 'pages.blocks' THEN 'pages.blocks.children' WHEN p = 'pages.blocks.children' THEN p || '^2' ELSE 'pages.blocks.children^' || (split_part(p, '^', 2)::INT + 1) END ELSE p END,
    CASE WHEN st IN ('pages', 'blocks', 'parts') THEN list_append(o, idx) ELSE o END, CASE WHEN st2 IN ('pages', 'blocks', 'parts') THEN p ELSE pp END, CASE WHEN st2 IN ('pages', 'blocks', 'parts') THEN o ELSE po END
  FROM (SELECT n.*, try_cast(e.key::VARCHAR AS INT) AS idx, {_plain('e.key::VARCHAR')} AS name,
      CASE WHEN st = 'top' AND json_type(n.v) = 'VARCHAR' THEN 'top' WHEN st IN ('top', 'wrap') AND json_type(n.v) = 'OBJECT' AND {_HAS_PAGES} THEN CASE WHEN name = 'pages' AND e.type <> 'NULL' THEN 'pages' END
        WHEN st IN ('top', 'wrap') AND e.type IN ('OBJECT', 'ARRAY') THEN 'wrap' WHEN e.type = 'NULL' THEN NULL WHEN st = 'pages' THEN 'page' WHEN st = 'page' AND json_type(n.v) = 'OBJECT' AND name = 'blocks' THEN 'blocks' WHEN st = 'blocks' THEN 'block'
        WHEN st = 'block' AND json_type(n.v) = 'OBJECT' AND name = 'children' THEN 'blocks' WHEN st = 'block' AND json_type(n.v) = 'OBJECT' AND name IN ('items', 'cells') THEN 'parts' WHEN st = 'parts' THEN 'part' END AS st2,
      CASE WHEN st IN ('top', 'wrap') AND json_type(n.v) = 'OBJECT' AND {_HAS_PAGES} OR st IN ('page', 'block') THEN CASE WHEN e.type = 'ARRAY' THEN e.value ELSE json_array(e.value) END ELSE e.value END AS v2, {_get('e.value', 'pageindex')} AS own, {_get('e.value', 'id')} AS id2
    FROM n, json_each(CASE WHEN json_type(n.v) IN ('OBJECT', 'ARRAY') THEN n.v WHEN st = 'top' AND json_type(n.v) = 'VARCHAR' AND json_valid(json_extract_string(n.v, '$')) THEN json_array(json_extract_string(n.v, '$')::JSON) ELSE '[]'::JSON END) e) WHERE st2 IS NOT NULL)"""
_NUMBERED = f"""{_WALK}, i AS (SELECT *, row_number() OVER (PARTITION BY rec_id, p ORDER BY o) AS nth FROM n WHERE st IN ('page', 'block', 'part')),
    l AS (SELECT i.*, u.nth AS up, t.nth AS top FROM i LEFT JOIN i u ON u.rec_id = i.rec_id AND u.p = i.pp AND u.o = i.po LEFT JOIN i t ON t.rec_id = i.rec_id AND t.p = 'pages' AND t.o = i.o[1:1])"""
_LINKS = "rec_id, p AS path, nth::INT AS n, pp AS parent_path, up::INT AS parent_n, top::INT AS top_n, pos AS place"


def queries() -> dict:
    return {"p3_found": p3_found, "p3_pages": p3_pages, "p3_blocks": p3_blocks, "p3_items": p3_items, "p3_rows": p3_rows, "p3_metadata": p3_metadata}


def oracle_sql() -> dict[str, str]:
    box = f"json_extract(v, {_member('v', 'bbox')})"
    side = lambda name, i: f"CASE json_type({box}) WHEN 'ARRAY' THEN json_extract_string({box}, '$[{i}]') ELSE {_get(box, name)} END AS box_{name}"
    origin = f"json_extract(v, {_member('v', 'provenance')})"
    fields = lambda *xs: ", ".join(f"{_get('v', k)} AS {c}" for k, c in xs)
    return {
        "p3_found": f"WITH RECURSIVE {_WALK} SELECT DISTINCT rec_id, page AS page_index, bid AS block_id, parent AS parent_id, CASE st WHEN 'part' THEN pos ELSE -1 END AS item_pos FROM n WHERE st IN ('block', 'part')",
        "p3_metadata": f"WITH RECURSIVE {_WALK}, md AS (SELECT rec_id, 'metadata' AS field, json_extract(v, {_member('v', 'metadata')}) AS x FROM n WHERE st IN ('top', 'wrap') AND json_type(v) = 'OBJECT' AND {_HAS_PAGES} UNION ALL SELECT rec_id, field || '.' || {_plain('e.key::VARCHAR')}, e.value FROM md, json_each(CASE WHEN json_type(x) = 'OBJECT' THEN x ELSE '[]'::JSON END) e) SELECT rec_id, field, json_extract_string(x, '$') AS value FROM md WHERE json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL')",
        "p3_pages": f"WITH RECURSIVE {_NUMBERED} SELECT rec_id, nth::INT AS n, page AS page_index, pos AS place, {fields(('width', 'width'), ('height', 'height'), ('rotation', 'rotation'))} FROM l WHERE st = 'page'",
        "p3_blocks": f"WITH RECURSIVE {_NUMBERED} SELECT {_LINKS}, {fields(('id', 'block_id'), ('blocktype', 'block_type'), ('text', 'text'), ('caption', 'caption'), ('readingorderindex', 'reading_order_index'))}, {', '.join(side(x, i) for i, x in enumerate(('left', 'top', 'right', 'bottom')))}, {_get(origin, 'provider')} AS provider, {_get(origin, 'confidence')} AS confidence FROM l WHERE st = 'block'",
        "p3_items": f"WITH RECURSIVE {_NUMBERED} SELECT {_LINKS}, {fields(('text', 'text'), ('marker', 'marker'), ('rowindex', 'row_index'), ('colindex', 'col_index'), ('rowspan', 'row_span'), ('colspan', 'col_span'))} FROM l WHERE st = 'part'",
    }
