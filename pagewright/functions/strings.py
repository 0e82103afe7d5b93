"""Column expressions on strings."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Line ends; white space that is stripped; letters with case.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
SPACE = r"[\s\u000b\u001c-\u001f\u0085   -     　]"
SPACES = "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
# What marks a string or a key as secret.
SECRET_PARTS = ("hf_", "sk-")
SECRET_WORDS = ("token", "secret")
SECRET_KEYS = ("token", "key", "secret", "auth", "password")
REDACTED = "[REDACTED_SECRET]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """The lines of a text, as an array."""
    return F.split(c, LINE_END, -1)


def is_title(c: Column) -> Column:
    """Every word begins with a capital and goes on in small letters; at least one letter has case."""
    return c.rlike(f"[{CASED}]") & ~c.rlike(rf"(^|[^{CASED}])\p{{Ll}}") & ~c.rlike(rf"[{CASED}][\p{{Lu}}\p{{Lt}}]")


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{SPACE}+", -1), lambda w: w != ""))


def mask_secrets(c: Column) -> Column:
    """The string, or a mark in its place if it looks like a secret."""
    low = F.lower(c)
    hit = F.lit(False)
    for p in SECRET_PARTS:
        hit = hit | c.contains(p)
    for w in SECRET_WORDS:
        hit = hit | low.contains(w)
    return F.when(hit, REDACTED).otherwise(c)


def mask_map(c: Column) -> Column:
    """A map with values masked where the key or the value looks like a secret."""

    def one(k: Column, v: Column) -> Column:
        hit = F.lit(False)
        for w in SECRET_KEYS:
            hit = hit | F.lower(k).contains(w)
        return F.when(hit, REDACTED).otherwise(mask_secrets(v))

    return F.transform_values(c, one)


def safe_file_name(c: Column, default: str = "uploaded_document") -> Column:
    """The last part of a path, letters, digits and ._- only."""
    name = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._-]", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def stem(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def suffix(c: Column) -> Column:
    """The extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(c, r"[^/.][^/]*(\.[^./]+)$", 1))


def utc_stamp(c: Column) -> Column:
    """Whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def signature(secret: str):
    """HMAC-SHA256 of a string column, in hexadecimal."""
    key = secret.encode()

    @F.pandas_udf(T.StringType())
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hmac.new(key, x.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return sign
