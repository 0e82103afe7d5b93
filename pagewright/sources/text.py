"""Plain text, Markdown and HTML documents as rows of blocks.

Each takes doc_id and a text column and gives doc_id, page_index, pos, block_id,
block_type, text, heading_level, ordered, items. One page is a document; its box is the page.
Null and empty documents have no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.strings import lines, strip

COLUMNS = ["doc_id", "page_index", "pos", "block_id", "block_type", "text", "heading_level", "ordered", "items"]


def _kept_lines(df: DataFrame, text: str) -> DataFrame:
    """doc_id, pos, s: stripped lines that aren't blank, numbered in the document."""
    kept = F.filter(F.transform(lines(F.col(text)), strip), lambda s: s != "")
    return df.select("doc_id", F.posexplode(kept).alias("pos", "s"))


def _block(kind: Column, text: Column, level: Column, ordered: Column, items: Column, block_id: Column) -> list[Column]:
    return ["doc_id", F.lit(0).alias("page_index"), "pos", block_id.alias("block_id"), kind.alias("block_type"), text.alias("text"), level.cast("int").alias("heading_level"), ordered.cast("boolean").alias("ordered"), items.cast("array<string>").alias("items")]


def txt_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """A paragraph for each line."""
    null = F.lit(None)
    return _kept_lines(df, text).select(*_block(F.lit("paragraph"), F.col("s"), null, null, null, F.concat(F.lit("txt_b_"), "pos")))


def markdown_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Headings by their #, a list for each bullet line, paragraphs; the ids share one counter."""
    s = F.col("s")
    heading, bullet = s.startswith("#"), s.rlike(r"^[*+-] ")
    level = F.when(heading, F.least(F.lit(6), F.length(F.regexp_extract("s", "^(#+)", 1))))
    inner = F.when(heading, strip(F.regexp_replace("s", "^#+", ""))).when(bullet, F.lit(None)).otherwise(s)
    kind = F.when(heading, "heading").when(bullet, "list").otherwise("paragraph")
    mark = F.when(heading, "md_h_").when(bullet, "md_l_").otherwise("md_p_")
    items = F.when(bullet, F.array(strip(F.substring("s", 3, 1 << 30))))
    return _kept_lines(df, text).select(*_block(kind, inner, level, F.when(bullet, F.lit(False)), items, F.concat(mark, "pos")))


def html_blocks(df: DataFrame, html: str = "html") -> DataFrame:
    """h1 to h6 and p without attributes, tags inside removed, entities as they are; empty ones are left out but count.
    A document without any such tag is one paragraph of its text."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?>.*?</script>", ""), r"(?is)<style.*?>.*?</style>", "")
    pattern = F.lit(r"(?is)<(h[1-6]|p)>(.*?)</\1>")
    base = df.select("doc_id", bare.alias("bare"))
    parts = base.select("doc_id", "bare", F.regexp_extract_all("bare", pattern, 1).alias("tags"), F.regexp_extract_all("bare", pattern, 2).alias("inner"))
    found = parts.where(F.size("tags") > 0).select("doc_id", F.posexplode(F.arrays_zip("tags", "inner")).alias("pos", "m"))
    found = found.select("doc_id", "pos", F.lower("m.tags").alias("tag"), strip(F.regexp_replace("m.inner", "<.*?>", "")).alias("s"))
    none = parts.where(F.size("tags") == 0).select("doc_id", F.lit(0).alias("pos"), F.lit("p").alias("tag"), strip(F.regexp_replace("bare", "<.*?>", "")).alias("s"))
    both = found.unionByName(none).where("s != ''")
    heading = F.col("tag").startswith("h")
    null = F.lit(None)
    return both.select(*_block(F.when(heading, "heading").otherwise("paragraph"), F.col("s"), F.when(heading, F.substring("tag", 2, 1).cast("int")), null, null, F.concat(F.lit("html_b_"), "pos")))
