"""Texts that look the same but differ in their characters, brought to one form.

Two forms: `look` keeps what a reader can see (case, accents, raised digits) and drops
what cannot be seen (width, composition, ligatures, invisible characters, script of a
letter); `fold` is the same with full case folding, for comparisons that ignore case.

Texts of printable ASCII are their own form but for runs of spaces, which is settled
in the JVM; the others are normalised once per distinct value in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.scratch import written
from pagewright.functions.skew import PART_ROWS, split_join

# Letters of other scripts that look like a Latin letter (Cyrillic, Greek, Armenian, Cherokee, phonetic).
LETTERS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ɑ": "a", "ɡ": "g",
}
# Hyphens that look like the common one.
HYPHENS = "‐‑－﹣"
# Compatibility mappings that a reader cannot see; raised, lowered, circled, squared, styled forms and fractions show.
UNSEEN_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _unseen(c: str) -> str:
    """The character in its visible form: empty if it is invisible."""
    if c in HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Cf" or c in "ᅟᅠㅤﾠ͏឴឵" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or 0x180B <= ord(c) <= 0x180F:
        return ""
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        tag, *rest = d.split()
        if tag in UNSEEN_TAGS:
            return "".join(_unseen(chr(int(x, 16))) for x in rest)
    return c


class _Visible(dict):
    """Code points -> their visible form, found out once each, for str.translate."""

    def __missing__(self, point: int) -> str:
        self[point] = _unseen(chr(point))
        return self[point]


_VISIBLE, _LETTERS = _Visible(), str.maketrans(LETTERS)


def _seen(s: str) -> str:
    parts = unicodedata.normalize("NFD", s.translate(_VISIBLE))
    return unicodedata.normalize("NFC", parts.translate(_LETTERS))


#: A text of Latin letters, with or without accents, each of which is its own form; none of them joins with its neighbours.
_LATIN = re.compile(f"[\\t\\n\\r -~{''.join(c for c in map(chr, range(0xA1, 0x180)) if _seen(c) == c)}]*")
_SPACES = re.compile(r"[ \t]+")


def look(s: str) -> str:
    """The form in which two texts are equal if and only if they look the same.

    Letters are taken apart from their accents before their script is mapped, so that an accented
    look-alike comes out as the accented Latin letter; the result is in composed form. Runs of spaces
    are one space, and spaces at the ends or around line breaks go."""
    if not _LATIN.fullmatch(s):
        s = _seen(s)
    lines = _SPACES.sub(" ", s.replace("\r\n", "\n").replace("\r", "\n")).split("\n")
    return "\n".join(x.strip(" ") for x in lines).strip("\n")


def fold(s: str) -> str:
    """look() with full case folding, in composed form."""
    return unicodedata.normalize("NFC", look(s).casefold())


def _distinct(f):
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        out = pd.Series([f(v) for v in values], dtype=object)
        return pd.Series(out.reindex(codes).values, index=s.index).where(s.notna(), None)

    return run


look_udf = F.pandas_udf(_distinct(look), T.StringType())
fold_udf = F.pandas_udf(_distinct(fold), T.StringType())

#: What keeps a text from being its own form: anything but printable ASCII, two spaces, spaces at the ends. A plain search,
#: as repeated groups would take stack for every word of a long text.
NOT_PLAIN = r"[^ -~]|  |^ | $"


def with_forms(df: DataFrame, column: str, look_as: str = "look", fold_as: str | None = "fold") -> DataFrame:
    """Adds the forms of a text column; null stays null, an empty text stays empty. Columns of the same
    names are replaced. Plain texts never leave the JVM."""
    text = F.col(column)
    plain = ~text.rlike(NOT_PLAIN)
    out = df.withColumn(look_as, F.when(plain, text).otherwise(look_udf(F.when(~plain, text))))
    if fold_as:
        out = out.withColumn(fold_as, F.when(plain, F.lower(text)).otherwise(fold_udf(F.when(~plain, text))))
    return out


def _formed(df: DataFrame, key: str, column: str) -> DataFrame:
    """uid, t1, t2 (the text, hashed), f1, f2 (its form, hashed) of every row with text; a row that is repeated once or more."""
    one = df.where(F.col(column).isNotNull()).select(F.col(key).alias("uid"), F.col(column).alias("text"))
    ids = one.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), "text"))
    return with_forms(ids, "text", "look", None).select("uid", "t1", "t2", F.xxhash64("look").alias("f1"), F.xxhash64(F.lit(7), "look").alias("f2"), (F.col("look") != "").alias("seen"))


def classes(df: DataFrame, key: str, column: str, part_rows: int = PART_ROWS) -> DataFrame:
    """A row for each key with a text: uid, class_uid (the least key whose text looks like it), texts (different texts of
    the class) and links (those that differ from its own). Counts are made per form before rows meet them; a form that many
    rows share is split."""
    formed = written(_formed(df, key, column).distinct(), "forms")
    kinds = formed.groupBy("f1", "f2", "t1", "t2").agg(F.min("uid").alias("uid"))
    of = kinds.groupBy("f1", "f2").agg(F.min("uid").alias("class_uid"), F.count("*").alias("texts"))
    out = split_join(formed, of, ["f1", "f2"], ["uid"], part_rows)
    return out.select("uid", "class_uid", "texts", (F.col("texts") - 1).alias("links"))


def same_look(df: DataFrame, key: str, column: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs of rows whose texts differ but look the same: a, b (a < b).

    Different texts of one form are paired first, one row a text; pairs of texts become pairs of rows by two joins, in which
    a text that many rows have is split. Null texts have no pairs, nor have texts in which there is nothing
    to see; rows of equal texts are no pair; a key that is repeated counts once."""
    formed = written(_formed(df, key, column).where("seen").drop("seen"), "forms")
    several = formed.groupBy("f1", "f2").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.min("t2").alias("lo2"), F.max("t2").alias("hi2")).where("lo != hi or lo2 != hi2").select("f1", "f2")
    rows = written(formed.join(several, ["f1", "f2"], "left_semi").distinct(), "alike")
    kinds = rows.select("f1", "f2", "t1", "t2").distinct()
    x = kinds.select("f1", "f2", F.struct("t1", "t2").alias("x"))
    y = kinds.select("f1", "f2", F.struct("t1", "t2").alias("y"))
    pairs = x.join(y, ["f1", "f2"]).where("x < y").select("x", "y")
    mine = rows.select(F.struct("t1", "t2").alias("x"), F.col("uid").alias("a"))
    half = written(split_join(mine, pairs, ["x"], ["a"], part_rows).select("a", "y"), "halves")
    theirs = rows.select(F.struct("t1", "t2").alias("y"), F.col("uid").alias("b"))
    both = split_join(half, theirs, ["y"], ["a"], part_rows)
    return both.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
