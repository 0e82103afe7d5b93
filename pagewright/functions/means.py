"""Means that don't depend on the order of rows: of whole numbers of a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(c: Column, places: int) -> Column:
    """A value in whole units of its last decimal place."""
    return F.round(c * 10.0**places).cast("long")


def mean(c: Column, places: int, to: int | None = None) -> Column:
    """Aggregate: the mean of values of so many decimal places, rounded half up to `to` places (as many, by default)."""
    to = places if to is None else to
    u = units(c, places)
    s, n, k = F.sum(u), F.count(u), 10 ** (places - to)
    return F.when(n > 0, F.floor((2 * s + n * k) / (2 * n * k)) / 10.0**to)
