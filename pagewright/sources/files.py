"""Files as rows: folders of documents, Office files, JSON documents, ground truth and manifests."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.geometry import normalized, polygon_box
from pagewright.functions.strings import stem, suffix
from pagewright.sources.detect import EXTENSIONS, detect
from pagewright.sources.text import html_blocks, markdown_blocks, txt_blocks

MOST_BYTES = 100 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
BLOCKS = "doc_id string, page_index int, pos int, block_id string, block_type string, text string, heading_level int"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder but hidden ones, with its bytes, format and status; files that are too large are listed
    without being read, as the size is filtered in the source."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = base.where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith("."))
    small = base.where(F.col("length") <= MOST_BYTES).withColumn("found", detect(F.col("content"), F.col("path")))
    status = F.coalesce("found.error", F.lit("ok"))
    fine = small.select("path", "length", "content", "found.format", "found.confidence", "found.method", status.alias("status"))
    null = F.lit(None)
    large = base.where(F.col("length") > MOST_BYTES).select("path", "length", null.cast("binary").alias("content"), null.cast("string").alias("format"), null.cast("double").alias("confidence"), null.cast("string").alias("method"), F.lit("oversized").alias("status"))
    return fine.unionByName(large)


def _docx(content: bytes) -> list[tuple[str, str, int | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = next((s.get(f"{_W}val") or "" for s in p.iter(f"{_W}pStyle")), "")
        if text:
            m = re.match(r"(?i)heading\s*(\d)", style)
            out.append(("heading", text, int(m[1])) if m else ("list" if style.startswith("List") else "paragraph", text, None))
    return out


def _pptx(content: bytes) -> list[list[str]]:
    """Paragraphs of each slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        slides = [ElementTree.fromstring(z.read(n)) for n in names]
    return [[t for p in s.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())] for s in slides]


def office_blocks(files: DataFrame) -> DataFrame:
    """doc_id, format, content of Word and presentation files -> blocks; broken files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, kind, content in zip(pdf.doc_id, pdf.format, pdf.content, strict=True):
                try:
                    if kind == "docx":
                        rows += [(doc, 0, i, f"docx_b_{i}", k, t, level) for i, (k, t, level) in enumerate(_docx(content))]
                    else:
                        rows += [(doc, page, i, f"pptx_{page}_b_{i}", "paragraph", t, None) for page, ts in enumerate(_pptx(content)) for i, t in enumerate(ts)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                    continue
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])
            out["heading_level"] = out["heading_level"].astype("Int32")
            yield out

    return files.where("format in ('docx', 'pptx')").select("doc_id", "format", "content").mapInPandas(run, BLOCKS)


def image_blocks(files: DataFrame) -> DataFrame:
    """A figure for each raster image; its bytes aren't decoded."""
    return files.where("format = 'image'").select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("pos"), F.lit("img_b_0").alias("block_id"), F.lit("figure").alias("block_type"), F.lit("Raster Image Payload").alias("text"), F.lit(None).cast("int").alias("heading_level"))


def blocks(files: DataFrame) -> DataFrame:
    """doc_id, format, content -> blocks, by the source of each format."""
    text = F.make_valid_utf8(F.col("content").cast("string"))  # broken bytes are replaced
    cols = [c.split()[0] for c in BLOCKS.split(", ")]
    plain = lambda kind, f, name: f(files.where(F.col("format") == kind).select("doc_id", text.alias(name))).select(*cols)
    parts = [plain("txt", txt_blocks, "text"), plain("markdown", markdown_blocks, "text"), plain("html", html_blocks, "html"), office_blocks(files), image_blocks(files)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ground_truth(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON documents, one a file; broken ones have nulls in every field."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return text.select("path", F.from_json("value", schema).alias("j")).select("path", "j.*")


def cases(listing: DataFrame) -> DataFrame:
    """path of files -> cases of known extensions, with the JSON file of the same stem beside them as their ground truth."""
    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    f = listing.select("path", folder.alias("folder"), stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"))
    truth = f.where("suffix = '.json'").select("folder", "stem", F.col("path").alias("truth_path"))
    known = [e for e in EXTENSIONS if e not in (".htm", ".markdown")]
    return f.where(F.col("suffix").isin(*known)).join(truth, ["folder", "stem"], "left").select(F.col("stem").alias("case_id"), "path", "truth_path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a corpus manifest: a JSON object with a list of cases."""
    case = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("case_id", "file_path", "doc_type", "description", "ground_truth_path")]))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json(F.get_json_object("value", "$.cases"), case)).alias("c")).select("c.*")


def remote_ocr(responses: DataFrame) -> DataFrame:
    """request_id, body of OCR services -> regions; confidences are kept in 0 to 1, a missing box is the page, and a response
    without regions is one region of its full text."""

    def one(body: str | None) -> list[tuple]:
        try:
            j = json.loads(body or "")
        except ValueError:
            return []
        if not isinstance(j, dict):
            return []
        found = [r for r in j.get("regions") or [] if isinstance(r, dict)]
        if not found:
            text = j.get("full_text") or j.get("text")
            found = [{"text": text, "confidence": j.get("confidence", 1.0)}] if text else []
        return [(r.get("text"), min(1.0, max(0.0, float(r.get("confidence", 1.0)))), [float(x) for x in (r.get("bbox") or (0, 0, 1, 1))]) for r in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, *r) for i, b in zip(pdf.request_id, pdf.body, strict=True) for k, r in enumerate(one(b))]
            yield pd.DataFrame(rows, columns=["request_id", "pos", "text", "confidence", "bbox"])

    return responses.select("request_id", "body").mapInPandas(run, "request_id long, pos int, text string, confidence double, bbox array<double>")


def polygon_regions(images: DataFrame, least: float = 0.5) -> DataFrame:
    """What an OCR engine found on images (image_id, width, height in pixels, found: array of points (x, y), text, confidence)
    -> image_id, region_idx (the place in what was found), text, confidence and box as shares of the image. Regions below the
    least confidence are left out, as are those without points."""
    r = images.select("image_id", "width", "height", F.posexplode("found").alias("region_idx", "f")).where((F.col("f.confidence") >= least) & (F.size("f.points") > 0))
    box = normalized(*[x / F.col(side) for x, side in zip(polygon_box(F.col("f.points")), ("width", "height", "width", "height"), strict=True)])
    sides = [x.alias(n) for x, n in zip(box, ("left", "top", "right", "bottom"), strict=True)]
    return r.select("image_id", "region_idx", "f.text", F.round("f.confidence", 4).alias("confidence"), *sides)


def region_text(regions: DataFrame) -> DataFrame:
    """image_id, full_text: the texts of an image's regions, one a line."""
    lines = F.array_sort(F.collect_list(F.struct("region_idx", "text")))
    return regions.groupBy("image_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("full_text"))


def word_rows(words: DataFrame, least: float = 0.0) -> DataFrame:
    """Words of an OCR engine (page_id, pos, text, conf in per cent; below 0 for none) -> the page's text and mean confidence."""
    w = words.where((F.col("conf") >= 0) & (F.trim("text") != "")).withColumn("confidence", F.least(F.lit(1.0), F.col("conf") / 100)).where(F.col("confidence") >= least)
    return w.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"))


# The formats that have a source, with the extensions and types by which they are known besides.
SOURCES = {
    "txt": ([".txt"], ["text/plain"]),
    "markdown": ([".md", ".markdown"], ["text/markdown"]),
    "html": ([".html", ".htm"], ["text/html"]),
    "docx": ([".docx"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]),
    "pptx": ([".pptx"], ["application/vnd.openxmlformats-officedocument.presentationml.presentation"]),
    "image": ([".png", ".jpg", ".jpeg", ".webp", ".tiff", ".tif"], ["image/png", "image/jpeg", "image/webp", "image/tiff"]),
    "pdf": ([".pdf"], ["application/pdf"]),
}
#: Sources that take a file but can't read it here: a decoder must give its lines and images.
STUBS = ("pdf",)


def source_of(fmt: Column, extension: Column, mime: Column) -> Column:
    """The source for a file: that of its detected format, else the first that knows its extension or type; null for none."""
    f = F.lower(fmt)
    out = F.when(f.isin(*SOURCES), f)
    for name, (extensions, types) in SOURCES.items():
        out = out.when(F.lower(extension).isin(*extensions) | F.lower(mime).isin(*types), name)
    return out


def refused(files: DataFrame) -> DataFrame:
    """doc_id, format, extension, mime of files that no source reads -> doc_id, error."""
    s = source_of(F.col("format"), F.col("extension"), F.col("mime"))
    stub = F.concat(F.lit("source of "), s, F.lit(" is a placeholder and needs a decoder"))
    return files.select("doc_id", F.when(s.isNull(), "unsupported format").when(s.isin(*STUBS), stub).alias("error")).where("error is not null")


# The entries of a file's properties that have a column of their own.
PROPERTIES = {"title": "Title", "author": "Author", "subject": "Subject", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "mod_date": "ModDate"}


def properties(raw: Column) -> list[Column]:
    """A decoder's map of properties as columns, blank ones null, and the map of all others."""
    named = [F.nullif(F.element_at(raw, v), F.lit("")).alias(k) for k, v in PROPERTIES.items()]
    return [*named, F.map_filter(raw, lambda k, v: ~k.isin(*PROPERTIES.values())).alias("extra")]


def sample_cases(spark: SparkSession) -> DataFrame:
    """The cases a benchmark runs over where no corpus is given: a digital and a scanned document, with their ground truth."""
    heading, body, scanned = "CI Benchmark Digital Document Header", "Sample paragraph text for testing accuracy.", "Scanned Page Content"
    element = "struct<type:string,text:string,bbox:array<double>,page_index:int>"
    rows = [
        ("ci_digital_doc", "pdf", "CI Digital PDF Fixture", f"{heading} {body}", [("heading", heading, [0.1, 0.1, 0.9, 0.2], 0), ("text", body, [0.1, 0.25, 0.9, 0.5], 0)]),
        ("ci_scanned_doc", "pdf", "CI Scanned PDF Fixture", scanned, []),
    ]
    return spark.createDataFrame(rows, f"case_id string, doc_type string, description string, text_content string, elements array<{element}>")
