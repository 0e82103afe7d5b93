"""Queries over sources and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import strings
from pagewright.functions.tables import table
from pagewright.sources.detect import detect
from pagewright.sources.text import html_blocks, markdown_blocks, txt_blocks

# SQL forms of the classes in functions.strings.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_KEPT = f"""kept AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{_LINES}'), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM documents),
    ls AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM kept)"""


def txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt_blocks(table(spark, sf_dir, "documents")).select("doc_id", "page_index", "pos", "block_id", "block_type", "text")


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_blocks(table(spark, sf_dir, "documents")).select("doc_id", "pos", "block_id", "block_type", "text", "heading_level", "ordered", F.col("items")[0].alias("item"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in HTML: a heading, a script, a paragraph for each line; every third has no tags at all."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    tagged = F.concat(F.lit('<h1>Document <b>'), F.col("doc_id").cast("string"), F.lit('</b></h1><script>var t="</p>";</script><style>p{}</style><p>'), F.regexp_replace("text", "\n", "</p><P>"), F.lit("</p>"))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(tagged).alias("html"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(_html(spark, sf_dir)).select("doc_id", "pos", "block_id", "block_type", "text", "heading_level")


_HTML_SQL = rf"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<h1>Document <b>' || doc_id || '</b></h1><script>var t="</p>";</script><style>p{{}}</style><p>' || replace(text, chr(10), '</p><P>') || '</p>' END AS html FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', '', 'g'), '(?is)<style.*?>.*?</style>', '', 'g') AS bare FROM h),
    m AS (SELECT doc_id, bare, regexp_extract_all(bare, '(?is)<h1>.*?</h1>|<h2>.*?</h2>|<h3>.*?</h3>|<h4>.*?</h4>|<h5>.*?</h5>|<h6>.*?</h6>|<p>.*?</p>') AS l FROM b),
    t AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM m WHERE len(l) > 0),
    s AS (SELECT doc_id, pos, lower(regexp_extract(x, '^<([^>]*)>', 1)) AS tag, {_strip("regexp_replace(regexp_replace(x, '(?s)^<[^>]*>(.*)</[^>]*>$', '\\1'), '<.*?>', '', 'g')")} AS s FROM t
      UNION ALL SELECT doc_id, 0, 'p', {_strip("regexp_replace(bare, '<.*?>', '', 'g')")} FROM m WHERE len(l) = 0)
    SELECT doc_id, pos::INT AS pos, 'html_b_' || pos AS block_id, CASE WHEN tag LIKE 'h%' THEN 'heading' ELSE 'paragraph' END AS block_type, s AS text, CASE WHEN tag LIKE 'h%' THEN substr(tag, 2, 1)::INT END AS heading_level FROM s WHERE s <> ''"""


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as bytes under a name of its file's extension, some with magic bytes before them."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    k = F.col("doc_id") % 13
    head = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 2, F.unhex(F.lit("504B0304776F72642F"))).when(k == 3, F.encode(F.lit("  <!DOCTYPE HTML>"), "UTF-8"))
    head = head.when(k == 4, F.unhex(F.lit("524946460000000057454250"))).when(k == 5, F.unhex(F.lit("6100"))).otherwise(F.encode(F.lit(""), "UTF-8"))
    ext = F.when(k == 6, ".md").when(k == 7, ".pdf").when(k == 8, ".htm").otherwise("")
    d = d.select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"), F.concat(F.lit("in/doc"), F.col("doc_id").cast("string"), ext).alias("path"))
    out = d.select("doc_id", detect(F.col("content"), F.col("path")).alias("a"))
    return out.select("doc_id", "a.format", "a.confidence", "a.method", "a.error")


_DETECT_SQL = f"""WITH x AS (SELECT doc_id, doc_id % 13 AS k, text, substr(hex(encode(text)), 1, 4096) AS h FROM documents WHERE text IS NOT NULL),
    c AS (SELECT *, CASE WHEN length(h) < 4096 THEN 0 WHEN regexp_matches(h, '(C[2-9A-F]|[DEF].)$') THEN 1 WHEN regexp_matches(h, '[EF].[89AB].$') THEN 2 WHEN regexp_matches(h, 'F.[89AB].[89AB].$') THEN 3 ELSE 0 END AS cut FROM x),
    d AS (SELECT *, decode(unhex(substr(h, 1, (length(h) - 2 * cut)::INT))) AS t FROM c),
    f AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '{_LINES}'), lambda x: {_strip('x')}), lambda x: x <> '')[1:5] AS first FROM d),
    g AS (SELECT *, len(list_filter(first, lambda x: starts_with(x, '# ') OR starts_with(x, '## ') OR starts_with(x, '```'))) > 0 AS marked, k = 5 OR k NOT IN (6, 8) AND k > 4 AND cut > 0 AS bad FROM f)
    SELECT doc_id,
      CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'docx' WHEN 3 THEN 'html' WHEN 4 THEN 'image' ELSE CASE WHEN bad OR t = '' THEN NULL WHEN k = 6 THEN 'markdown' WHEN k = 8 THEN 'html' WHEN marked THEN 'markdown' ELSE 'txt' END END AS format,
      CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.95 WHEN 4 THEN 1.0 ELSE CASE WHEN bad OR t = '' THEN NULL WHEN k IN (6, 8) THEN 0.85 WHEN marked THEN 0.75 ELSE 0.5 END END::DOUBLE AS confidence,
      CASE WHEN k < 5 THEN 'magic_bytes' WHEN bad OR t = '' THEN NULL WHEN k IN (6, 8) THEN 'extension' ELSE 'content_heuristics' END AS method,
      CASE WHEN k = 5 THEN 'unsupported' WHEN k > 5 AND t = '' THEN '0 bytes' WHEN bad THEN 'unsupported' END AS error FROM g"""


def ingest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above a limit of 4000 bytes are refused."""
    d = table(spark, sf_dir, "documents")
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    return d.select("doc_id", n.alias("n_bytes"), F.when(n == 0, "0 bytes").when(n > 4000, "oversized").otherwise("ok").alias("status"))


def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strings.mask_secrets(F.col("text"))).alias("masked"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("doc_id", "doc_name", "title").distinct()
    odd = F.concat(F.lit("../in box/"), F.col("title"), F.lit("$.pdf"))
    return f.select("doc_id", "doc_name", strings.safe_file_name(odd).alias("safe_name"), strings.stem(F.col("doc_name")).alias("stem"), strings.suffix(F.col("doc_name")).alias("suffix"))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))


def arrival_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").groupBy("doc_id").agg(F.min("received_at").alias("t")).select("doc_id", strings.utc_stamp(F.col("t")).alias("received"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("doc_id", "doc_name").distinct().select("doc_id", strings.signature("k")(F.col("doc_name")).alias("signature"))


def queries() -> dict:
    return {
        "txt_blocks": txt, "md_blocks": md, "html_blocks": html, "detect_format": detect_format, "ingest_sizes": ingest_sizes, "mask_secrets": mask_secrets,
        "safe_names": safe_names, "checksums": checksums, "arrival_stamps": arrival_stamps, "signatures": signatures,
    }


def oracle_sql() -> dict[str, str]:
    inner, outer = (bytes(x ^ b for x in b"k".ljust(64, b"\0")).hex() for b in (0x36, 0x5C))
    return {
        "signatures": f"SELECT DISTINCT doc_id, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(doc_name)))) AS signature FROM files",
        "txt_blocks": f"WITH {_KEPT} SELECT doc_id, 0 AS page_index, pos::INT AS pos, 'txt_b_' || pos AS block_id, 'paragraph' AS block_type, s AS text FROM ls",
        "md_blocks": f"""WITH {_KEPT}, k AS (SELECT *, starts_with(s, '#') AS h, regexp_matches(s, '^[*+-] ') AS b FROM ls)
            SELECT doc_id, pos::INT AS pos, CASE WHEN h THEN 'md_h_' WHEN b THEN 'md_l_' ELSE 'md_p_' END || pos AS block_id, CASE WHEN h THEN 'heading' WHEN b THEN 'list' ELSE 'paragraph' END AS block_type,
            CASE WHEN h THEN {_strip("regexp_replace(s, '^#+', '')")} WHEN NOT b THEN s END AS text, CASE WHEN h THEN least(6, length(regexp_extract(s, '^(#+)', 1)))::INT END AS heading_level,
            CASE WHEN b AND NOT h THEN false END AS ordered, CASE WHEN b AND NOT h THEN {_strip("substr(s, 3)")} END AS item FROM k""",
        "html_blocks": _HTML_SQL,
        "detect_format": _DETECT_SQL,
        "ingest_sizes": "SELECT doc_id, coalesce(octet_length(encode(text)), 0)::INT AS n_bytes, CASE WHEN coalesce(octet_length(encode(text)), 0) = 0 THEN '0 bytes' WHEN octet_length(encode(text)) > 4000 THEN 'oversized' ELSE 'ok' END AS status FROM documents",
        "mask_secrets": "SELECT doc_id, md5(CASE WHEN contains(text, 'hf_') OR contains(text, 'sk-') OR contains(lower(text), 'token') OR contains(lower(text), 'secret') THEN '[REDACTED_SECRET]' ELSE text END) AS masked FROM documents",
        "safe_names": r"""SELECT DISTINCT doc_id, doc_name, coalesce(nullif(regexp_replace(title || '$.pdf', '[^\p{L}\p{N}._-]', '', 'g'), ''), 'uploaded_document') AS safe_name, regexp_replace(doc_name, '\.[^.]*$', '') AS stem, lower(regexp_extract(doc_name, '(\.[^.]+)$', 1)) AS suffix FROM files""",
        "checksums": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, '')))::INT AS n_bytes FROM documents",
        "arrival_stamps": "SELECT doc_id, strftime(min(received_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS received FROM files GROUP BY 1",
    }
