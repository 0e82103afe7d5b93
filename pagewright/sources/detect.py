"""The format of a file, from its first bytes, its name or its content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.strings import LINE_END, strip, suffix

#: Bytes looked at.
HEADER = 2048
# Names by which a format may be asked for; extensions; formats whose extension needs the magic bytes.
ALIASES = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "image": "image", "html": "html", "markdown": "markdown", "md": "markdown", "txt": "txt"}
EXTENSIONS = {
    ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".tif": "image",
    ".tiff": "image", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".txt": "txt",
}
BY_MAGIC_ONLY = ("pdf", "docx", "pptx", "image")
# Magic bytes in hexadecimal, the format and the MIME type.
MAGIC = [
    ("255044462D", "pdf", "application/pdf"),
    ("89504E470D0A1A0A", "image", "image/png"),
    ("FFD8FF", "image", "image/jpeg"),
    ("49492A00", "image", "image/tiff"),
    ("4D4D002A", "image", "image/tiff"),
]
MIME = {
    "pdf": "application/pdf", "html": "text/html", "markdown": "text/markdown", "txt": "text/plain",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "image": "image/png",
}
ZIP, RIFF, WEBP = "504B0304", "52494646", "57454250"
FENCE = "`" * 3


def _answer(format_: str | Column, mime: str | Column, confidence: float, method: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(format_).alias("format"), lit(mime).alias("mime"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), F.lit(None).cast("string").alias("error"))


def _failed(why: str) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(null.alias("format"), null.alias("mime"), F.lit(None).cast("double").alias("confidence"), null.alias("method"), F.lit(why).alias("error"))


def _from_map(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def detect(content: Column, path: Column, override: Column | None = None) -> Column:
    """struct<format, mime, confidence, method, error> by the first rule that holds: an override, emptiness,
    magic bytes, the extension, then the text itself."""
    head = F.substring(content, 1, HEADER)
    code = F.hex(head)
    ext = F.coalesce(suffix(path), F.lit(""))
    text = F.make_valid_utf8(head.cast("string"))
    start = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    begins = F.regexp_replace(start, r"^\s+", "")
    by_ext = _from_map(ext, EXTENSIONS)
    latin = F.decode(head, "ISO-8859-1")
    is_text = ~latin.contains("\u0000") & F.is_valid_utf8(head.cast("string"))
    first = F.slice(F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != ""), 1, 5)
    marked = F.exists(first, lambda x: x.startswith("# ") | x.startswith("## ") | x.startswith(FENCE))
    out = None

    def when(c: Column, answer: Column) -> None:
        nonlocal out
        out = F.when(c, answer) if out is None else out.when(c, answer)

    if override is not None:
        asked = _from_map(F.lower(strip(override)), ALIASES)
        when(override.isNotNull() & asked.isNull(), _failed("unsupported override"))
        when(override.isNotNull(), _answer(asked, _from_map(asked, MIME), 1.0, "explicit_override"))
    when(content.isNull() | (F.length(content) == 0), _failed("0 bytes"))
    for magic, name, mime in MAGIC:
        when(code.startswith(magic), _answer(name, mime, 1.0, "magic_bytes"))
    when(code.startswith(RIFF) & (F.substring(code, 17, 8) == WEBP), _answer("image", "image/webp", 1.0, "magic_bytes"))
    zipped = code.startswith(ZIP)
    for name, inner in (("docx", "word/"), ("pptx", "ppt/")):
        when(zipped & (ext == f".{name}"), _answer(name, MIME[name], 0.95, "magic_bytes"))
    for name, inner in (("docx", "word/"), ("pptx", "ppt/")):
        when(zipped & latin.contains(inner), _answer(name, MIME[name], 0.95, "magic_bytes"))
    when(begins.startswith("<!doctype html") | begins.startswith("<html"), _answer("html", MIME["html"], 0.95, "magic_bytes"))
    when(by_ext.isNotNull() & ~by_ext.isin(*BY_MAGIC_ONLY), _answer(by_ext, _from_map(by_ext, MIME), 0.85, "extension"))
    when(is_text & marked, _answer("markdown", MIME["markdown"], 0.75, "content_heuristics"))
    when(is_text, _answer("txt", MIME["txt"], 0.5, "content_heuristics"))
    return out.otherwise(_failed("unsupported"))
