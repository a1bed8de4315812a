"""Numeric expressions with defined results for nulls, NaN and zero denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """A double; null, text that isn't a number, NaN and infinities are 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def rounded(value: Column, places: int) -> Column:
    """Half up, where a half is one despite the noise of summing in another order."""
    return F.round(value + F.lit(1e-9), places)


def positive(value: Column) -> Column:
    return (value > 0) & ~F.isnan(value)


def share(part: Column, whole: Column) -> Column:
    """Percent of whole; 0 where whole is 0 or null."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100, F.lit(0.0))


def bucket(value: Column, width: int) -> Column:
    """Lower edge of value's bucket, as a whole number."""
    return (F.floor(value / width) * width).cast("long")


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean in an aggregation; null without weight."""
    return F.sum(value * weight) / F.nullif(F.sum(weight.cast("double")), F.lit(0.0))


def band(rate: Column) -> Column:
    """Severity of a percentage."""
    return F.when(rate > 5, "high").when(rate > 1, "medium").when(rate > 0, "low").otherwise("none")


def shown_count(value: Column) -> Column:
    """1,234 or a dash."""
    return F.when(value.isNull() | (value == 0), "—").otherwise(F.format_number(value, 0))


def shown_rate(value: Column) -> Column:
    """1.23% or a dash."""
    return F.when(value.isNull() | (value == 0), "—").otherwise(F.format_string("%.2f%%", value))
