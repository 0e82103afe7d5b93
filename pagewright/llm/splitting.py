"""Texts above a size limit, cut into overlapping pieces at natural boundaries.

Recursive bisection: a span that is too long is cut at the strongest boundary in its
middle half (the nearest to its midpoint among equals), and its parts are cut further while
they exceed the limit less the overlap; then every piece but the first is begun
`overlap` characters earlier. Characters are Unicode code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundaries from the strongest to the weakest; a cut is made after the match.
BOUNDARIES = [
    r"(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])+\s*",  # paragraphs
    r"(?:\r\n|[\n\r  ])[ \t]*",  # lines
    r"(?<![.!?…])[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*",  # sentences
    r"[;:,]\s+|[，、；：]|\s[–—-]\s",  # clauses
    r"\s+",  # words
]
_BOUNDARIES = [re.compile(b) for b in BOUNDARIES]
PIECES = "tbl string, row_uid long, piece int, piece_start int, piece_end int, piece_text string"


def _inseparable(text: str, at: int) -> bool:
    """Whether a cut at this place would part what is one character to a reader."""
    c, before = text[at], text[at - 1]
    return bool(unicodedata.combining(c)) or c in "‍️" or before == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff" or before == "\r" and c == "\n"


def _cut(text: str, places: list[list[int]], a: int, b: int) -> int:
    middle, reach = (a + b) // 2, max(1, (b - a) // 4)
    for level in places:
        lo, hi = bisect_left(level, max(a + 1, middle - reach)), bisect_right(level, min(b - 1, middle + reach))
        if lo < hi:
            return min(level[lo:hi], key=lambda x: (abs(x - middle), x))
    for d in range(reach):
        if middle - d > a and not _inseparable(text, middle - d):
            return middle - d
    return middle


def bisected(text: str, most: int) -> list[int]:
    """Where to cut so that no part is longer than `most`: the starts of the parts."""
    if len(text) <= most:
        return [0]
    places = [[m.end() for m in b.finditer(text)] for b in _BOUNDARIES]
    todo, starts = [(0, len(text))], []
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
        else:
            c = _cut(text, places, a, b)
            todo += [(a, c), (c, b)]
    return sorted(starts)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; one piece if the text is within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    starts = [*bisected(text, limit - overlap), len(text)]
    return [(max(0, a - overlap), b) for a, b in zip(starts, starts[1:], strict=False)]


def _split(texts: DataFrame, limits: DataFrame) -> DataFrame:
    size = {r.tbl: (r.max_size, r.overlap_size) for r in limits.collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tbl, uid, text in zip(pdf.tbl, pdf.row_uid, pdf.text, strict=True):
                rows += [(tbl, uid, i, a, b, text[a:b]) for i, (a, b) in enumerate(pieces(text, *size[tbl]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    over = F.lit(False)
    for tbl, (most, _) in size.items():
        over = over | ((F.col("tbl") == tbl) & (F.length("text") > most))
    return texts.where(over).select("tbl", "row_uid", "text").mapInPandas(run, PIECES)


def split(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """tbl, row_uid, text and limits (tbl, max_size, overlap_size; one row for each tbl) ->
    tbl, row_uid, piece, piece_start, piece_end, piece_text for texts above their limit.

    Null texts and those within the limit have no rows; a row delivered twice comes out once. Further columns
    are ignored. The limits are a small table of fixed size."""
    return _split(texts, limits).dropDuplicates(["tbl", "row_uid", "piece"])


def above_limit(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """tbl, row_uid of the texts that were cut: those that have a second piece."""
    return _split(texts, limits).where("piece = 1").select("tbl", "row_uid").distinct()
