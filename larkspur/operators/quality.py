"""Data quality of timestamped records: twelve checks in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import hours_between
from larkspur.functions.numbers import band

#: Fixed value: a dropoff that stands for none.
PLACEHOLDER = "1989-01-01 00:00:00"
#: Bounds of a duration and a fare, and the checks' names.
MOST_HOURS, MOST_FARE = 24, 500


def checks(pickup: Column, dropoff: Column, distance: Column, passengers: Column, fare: Column, year: Column, file_year: Column) -> dict[str, Column]:
    """Conditions by name; null where a value is missing, which counts as no issue. NaN is no issue either."""
    placeholder = F.lit(PLACEHOLDER).cast("timestamp_ntz")
    valid = dropoff.isNotNull() & (dropoff != placeholder)
    number = lambda c: F.when(~F.isnan(c), c)
    return {
        "invalid_year": F.abs(year - file_year) > 1,
        "null_pickup": pickup.isNull(),
        "null_dropoff": dropoff.isNull(),
        "placeholder_dropoff": dropoff == placeholder,
        "same_timestamps": valid & (pickup == dropoff),
        "negative_duration": valid & (dropoff < pickup),
        "excessive_duration": valid & (hours_between(pickup, dropoff) > MOST_HOURS),
        "zero_distance": number(distance) == 0,
        "negative_distance": number(distance) < 0,
        "zero_passengers": number(passengers) == 0,
        "negative_fare": number(fare) < 0,
        "high_fare": number(fare) > MOST_FARE,
    }


#: Fixed values, in the order of checks().
ISSUES = ("invalid_year", "null_pickup", "null_dropoff", "placeholder_dropoff", "same_timestamps", "negative_duration", "excessive_duration", "zero_distance", "negative_distance", "zero_passengers", "negative_fare", "high_fare")


def quality_by_year(records: DataFrame, *keys: str) -> DataFrame:
    """total_rows and a count for each check, by keys and year (the pickup's, else the file's).

    records: pickup, dropoff (timestamp_ntz), distance, passengers, fare (double), file_year, and the keys.
    """
    rows = records.withColumn("year", F.coalesce(F.year("pickup"), F.col("file_year")))
    found = checks(*[F.col(c) for c in ("pickup", "dropoff", "distance", "passengers", "fare", "year", "file_year")])
    return rows.groupBy(*keys, "year").agg(F.count("*").alias("total_rows"), *[F.count_if(c).alias(n) for n, c in found.items()])


def with_rates(report: DataFrame) -> DataFrame:
    """report with total_issues, issue_rate (percent, four places) and severity. A row may have several issues."""
    total = sum((F.col(c) for c in ISSUES), F.lit(0))
    rate = F.round(F.coalesce(total.cast("double") / F.nullif(F.col("total_rows"), F.lit(0)) * 100, F.lit(0.0)), 4)
    return report.withColumn("total_issues", total.cast("long")).withColumn("issue_rate", rate).withColumn("severity", band(F.col("issue_rate")))


def overall(report: DataFrame, *keys: str) -> DataFrame:
    """Sums of a report over its years."""
    sums = [F.sum(c).alias(c) for c in ("total_rows", *ISSUES)]
    return report.groupBy(*keys).agg(*sums) if keys else report.agg(*sums)


def active_issues(report: DataFrame) -> list[str]:
    """The checks that found anything, from one aggregation."""
    row = report.agg(*[F.sum(c).alias(c) for c in ISSUES]).first()
    return [c for c in ISSUES if row[c]]
