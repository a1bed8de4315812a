"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dow_sunday(ts: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(ts) - 1


def dow_monday(ts: Column) -> Column:
    """Day of the week, Monday 0."""
    return F.weekday(ts)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    return F.unix_timestamp(ts.cast("timestamp"))


def minute_boundaries(start: Column, end: Column) -> Column:
    """How many times the minute changes from start to end: 00:00:59 to 00:01:01 is 1."""
    return F.floor(seconds(end) / 60) - F.floor(seconds(start) / 60)


def hours_between(start: Column, end: Column) -> Column:
    """Exact duration in hours."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def parsed(text: Column, pattern: str | None = None) -> Column:
    """Timestamp of a text, null where it isn't one."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def iso(ts: Column) -> Column:
    """2024-03-01T07:05:00."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def now_iso() -> Column:
    """The query's start as an ISO text."""
    return iso(F.current_timestamp())


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp with or without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def year_between(df: DataFrame, ts: str, first: int, last: int, partition: str | None = None) -> DataFrame:
    """Rows whose timestamp lies in the years, written as a range so that the scan can skip row groups.

    With partition, the name of a year column that the table is partitioned by, whole folders are skipped as well.
    """
    kind = dict(df.dtypes)[ts]
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast(kind) for y in (first, last + 1))
    out = df.where((F.col(ts) >= low) & (F.col(ts) < high))
    return out.where(F.col(partition).between(first, last)) if partition else out


def months(spark, first: str, last: str) -> DataFrame:
    """One row (month: date) for each month from first to last."""
    return spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b), interval 1 month)) AS month", args={"a": first, "b": last})
