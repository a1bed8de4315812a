"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(number: Column, width: int) -> Column:
    """A whole number's text with zeros in front."""
    return F.lpad(number.cast("string"), width, "0")


def year_month(ts: Column) -> Column:
    """2024-03, as file names have it."""
    return F.concat(F.year(ts).cast("string"), F.lit("-"), padded(F.month(ts), 2))


def found(text: Column, pattern: str) -> Column:
    """The first group of the pattern, '' if there is none."""
    return F.regexp_extract(text, pattern, 1)


def label(text: Column, longest: int = 60) -> Column:
    """text without characters that file names don't have, and not longer than `longest`."""
    return F.substr(F.regexp_replace(text, r"[^0-9A-Za-z_.]", "_"), F.lit(1), F.lit(longest))
