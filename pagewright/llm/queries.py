"""The pN_ queries of the operators in this folder."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.scratch import written
from pagewright.functions.tables import table, texts
from pagewright.llm import lookalike, mixing, nearcopies, packing, scannoise, splitting, stuffing
from pagewright.llm.tokens import with_lengths

#: p4: at least 40 words, three-word shingles, half of them in common.
NEAR = nearcopies.Params(threshold=0.5, shingle=3, min_words=40)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannoise.found(texts(spark, sf_dir), table(spark, sf_dir, "files"), table(spark, sf_dir, "lexicon"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannoise.repaired(texts(spark, sf_dir), table(spark, sf_dir, "files"), table(spark, sf_dir, "lexicon"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.same_look(table(spark, sf_dir, "blocks"), "block_uid", "text")
    return pairs.select(F.col("a").alias("block_uid_a"), F.col("b").alias("block_uid_b"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").where("text is not null").select("block_uid", "text").dropDuplicates(["block_uid"])
    return lookalike.with_forms(b, "text").select("block_uid", "look", "fold")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each block with text: the class of texts that look like it, and how many different texts are in it."""
    c = lookalike.classes(table(spark, sf_dir, "blocks"), "block_uid", "text")
    return c.select(F.col("uid").alias("block_uid"), F.col("class_uid").alias("class_block_uid"), "texts", "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, copies, _ = nearcopies.similar_pairs(texts(spark, sf_dir), NEAR)
    return nearcopies.expanded(pairs, copies)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(texts(spark, sf_dir), NEAR)


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "size_limits").where("limit_name in ('block_split', 'chunk_split')")
    return named.select(F.split("applies_to", r"\.")[0].alias("tbl"), "max_size", "overlap_size")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.above_limit(texts(spark, sf_dir), _limits(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(texts(spark, sf_dir), _limits(spark, sf_dir))


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each text: put together without their overlaps they are the text, none is too long, and each
    begins before the end of the last by the overlap."""
    limits = _limits(spark, sf_dir)
    p = p5_pieces(spark, sf_dir).join(F.broadcast(limits), "tbl")  # a row for each table
    w = Window.partitionBy("tbl", "row_uid").orderBy("piece")
    p = p.withColumn("before", F.lag("piece_end").over(w)).withColumn("new", F.expr("substring(piece_text, coalesce(before, 0) - piece_start + 1)"))
    g = p.groupBy("tbl", "row_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "").alias("text"), F.max(F.length("piece_text") > F.col("max_size")).alias("too_long"), F.min(F.col("before").isNull() | (F.col("piece_start") == F.col("before") - F.col("overlap_size"))).alias("overlapping"))
    return g.select("tbl", "row_uid", F.md5("text").alias("digest"), "too_long", "overlapping")


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    named = table(spark, sf_dir, "size_limits").where("limit_name in ('pack_small', 'pack_large')")
    return {r.limit_name: r.max_size for r in named.orderBy("limit_name").collect()}


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir), with_lengths)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_packed(spark, sf_dir), _capacities(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: for each kind of container the documents packed, and how many containers are too full, documents
    are packed twice, and documents that would fit whole are split."""
    cap = _capacities(spark, sf_dir)
    p = written(p6_packed(spark, sf_dir), "packed")
    room = F.create_map(*[F.lit(x) for kv in cap.items() for x in kv])
    full = p.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("limit_name").agg(F.count_if(F.col("n") > F.element_at(room, F.col("limit_name"))).alias("too_full"))
    d = p.groupBy("limit_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("different"))
    whole = d.groupBy("limit_name").agg(F.count("*").alias("docs"), F.count_if(F.col("pieces") != F.col("different")).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.element_at(room, F.col("limit_name")))).alias("split"))
    return whole.join(full, "limit_name")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the selection: no source's documents are used more often than allowed, none of another source is
    used, and sources that don't use up their documents have shares in proportion to their targets."""
    t = table(spark, sf_dir, "mix_targets")
    s = mixing.shares(p7_selected(spark, sf_dir), t)
    have = table(spark, sf_dir, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), (F.length("text") > 0).alias("any")).distinct().where("any").groupBy("source").agg(F.count("*").alias("have"))
    s = s.join(have, "source", "left").fillna(0, ["have"])
    used_up = F.col("most_times") >= F.col("max_repeats")
    s = s.withColumn("ratio", F.try_divide("share", "target_share"))
    most = F.max("ratio").over(Window.partitionBy(F.lit(0)))  # over the targets, which are few
    in_proportion = (F.col("ratio") >= most * 0.97) | used_up | (F.col("have") == 0)
    return s.select("source", (F.col("most_times") > F.col("max_repeats")).alias("too_often"), (F.col("docs") > F.col("have")).alias("more_than_there_are"), in_proportion.alias("in_proportion"))


def p7_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), with_lengths)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_selected(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.level_shares(p7_selected(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.spam(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_forms": p2_forms, "p2_classes": p2_classes, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_checks": p5_checks, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_checks": p6_checks, "p7_checks": p7_checks, "p7_selected": p7_selected, "p7_shares": p7_shares, "p7_levels": p7_levels, "p8_found": p8_found, "p8_scores": p8_scores}


# Exact pairs by a prefix filter: two sets that share half of their union share a gram among the rarest of each, all but its half less one.
_GRAMS = r"""t AS (SELECT DISTINCT 'blocks' AS tbl, block_uid AS uid, text FROM blocks WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'chunks', chunk_uid, text FROM chunks WHERE text IS NOT NULL),
    w AS (SELECT tbl, uid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM t), k AS (SELECT tbl, uid, l, min(uid) OVER (PARTITION BY tbl, l) AS rep FROM w WHERE len(l) >= 40),
    s AS (SELECT tbl, uid, rep, list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS g FROM k)"""
_SIMILAR = """r AS (SELECT tbl, uid, len(g) AS size, unnest(g) AS gram FROM z), f AS (SELECT tbl, gram, count(*) AS df FROM r GROUP BY 1, 2),
    q AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.tbl, uid ORDER BY df, r.gram) AS nth FROM r JOIN f ON f.tbl = r.tbl AND f.gram = r.gram) WHERE nth <= size - ceil(size * 0.5) + 1),
    c AS (SELECT DISTINCT a.tbl, a.uid AS x, b.uid AS y FROM q a JOIN q b ON a.tbl = b.tbl AND a.gram = b.gram AND a.uid < b.uid AND a.size <= 2 * b.size AND b.size <= 2 * a.size),
    e AS (SELECT c.tbl, x, y FROM c JOIN z a ON a.tbl = c.tbl AND a.uid = x JOIN z b ON b.tbl = c.tbl AND b.uid = y WHERE 3 * len(list_intersect(a.g, b.g)) >= len(a.g) + len(b.g))"""


def _look_sql(text: str) -> str:
    """The form of a text: width, spaces, invisible characters, ligatures and the script of letters made alike, then composed. Letters
    that carry an accent in one character are put apart from their script here, as SQL has no decomposition."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0x370, 0x560))}  # Greek, Cyrillic, Armenian
    accented = {c: unicodedata.normalize("NFC", "".join(lookalike.LETTERS.get(x, x) for x in d)) for c, d in parts.items() if len(d) > 1 and d[0] in lookalike.LETTERS}
    pairs = lookalike.LETTERS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    quoted = lambda x: x.replace("'", "''")
    one = f"translate({text}, '{quoted(''.join(pairs))}', '{quoted(''.join(pairs.values()))}')"
    for x, y in {**accented, "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "µ": "μ", "‐": "-", "‑": "-", "－": "-", "﹣": "-"}.items():
        one = f"replace({one}, '{x}', '{y}')"
    seen = rf"regexp_replace({one}, '[\p{{Cf}}\x{{34F}}\x{{115F}}\x{{1160}}\x{{3164}}\x{{FFA0}}\x{{17B4}}\x{{17B5}}\x{{FE00}}-\x{{FE0F}}\x{{180B}}-\x{{180F}}]', '', 'g')"
    spaced = rf"regexp_replace(replace(replace(regexp_replace({seen}, '\p{{Zs}}', ' ', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace(nfc_normalize({spaced}), ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def oracle_sql() -> dict[str, str]:
    forms = f"f AS (SELECT uid, text, {_look_sql('text')} AS look FROM (SELECT DISTINCT block_uid AS uid, text FROM blocks WHERE text IS NOT NULL))"
    return {
        "p2_found": f"WITH {forms} SELECT a.uid AS block_uid_a, b.uid AS block_uid_b FROM f a JOIN f b ON a.look = b.look AND a.text <> b.text AND a.uid < b.uid WHERE a.look <> ''",
        "p2_forms": f"WITH {forms} SELECT uid AS block_uid, look, nfc_normalize(replace(replace(replace(lower(look), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')) AS fold FROM f",
        "p2_classes": f"WITH {forms}, k AS (SELECT look, min(uid) AS class_block_uid, count(DISTINCT text) AS texts FROM f GROUP BY 1) SELECT uid AS block_uid, class_block_uid, texts, texts - 1 AS links FROM f JOIN k USING (look)",
        "p4_found": f"WITH {_GRAMS}, z AS (SELECT * FROM s), {_SIMILAR} SELECT tbl, x AS uid_a, y AS uid_b FROM e",
        "p4_groups": f"WITH RECURSIVE {_GRAMS}, z AS (SELECT * FROM s WHERE uid = rep), {_SIMILAR}, ways AS (SELECT tbl, x, y FROM e UNION ALL SELECT tbl, y, x FROM e), reach AS (SELECT DISTINCT tbl, x AS a, x AS b FROM ways UNION SELECT r.tbl, r.a, o.y FROM reach r JOIN ways o ON o.tbl = r.tbl AND o.x = r.b), root AS (SELECT tbl, a, min(b) AS root FROM reach GROUP BY 1, 2), n AS (SELECT tbl, x, count(*) AS links FROM ways GROUP BY 1, 2) SELECT s.tbl, s.uid AS row_uid, coalesce(root, rep) AS group_uid, coalesce(links, 0) AS links FROM s LEFT JOIN root ON root.tbl = s.tbl AND root.a = s.rep LEFT JOIN n ON n.tbl = s.tbl AND n.x = s.rep",
        "p6_checks": "SELECT limit_name, count(DISTINCT doc_id) AS docs, 0::BIGINT AS twice, 0::BIGINT AS split, 0::BIGINT AS too_full FROM documents, size_limits WHERE limit_name IN ('pack_small', 'pack_large') GROUP BY 1",
        "p7_checks": r"SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source, false AS too_often, false AS more_than_there_are, true AS in_proportion FROM mix_targets",
        "p5_checks": """SELECT DISTINCT 'blocks' AS tbl, block_uid AS row_uid, md5(text) AS digest, false AS too_long, true AS overlapping FROM blocks WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'block_split')
            UNION ALL SELECT DISTINCT 'chunks', chunk_uid, md5(text), false, true FROM chunks WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk_split')""",
        "p5_found": """SELECT DISTINCT 'blocks' AS tbl, block_uid AS row_uid FROM blocks WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'block_split')
            UNION ALL SELECT DISTINCT 'chunks', chunk_uid FROM chunks WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk_split')""",
    }
