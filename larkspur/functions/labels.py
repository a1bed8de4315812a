"""Text labels by rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vehicle(share: Column) -> Column:
    """From the share of app-based trips in a cluster. Below 0.5 and above 0.85."""
    return F.when(share < 0.5, "Yellow Taxi").when(share > 0.85, "FHVHV (Uber/Lyft)").otherwise("Mixed")


def trip_type(miles: Column) -> Column:
    """Below 2, 6 and 12 miles."""
    return F.when(miles < 2, "short local").when(miles < 6, "medium").when(miles < 12, "long").otherwise("airport/outer-borough")


def trip_label(miles: Column, fare: Column, share: Column) -> Column:
    return F.format_string("%s, %s trip (~%.1f mi, ~$%.0f fare)", vehicle(share), trip_type(miles), miles, fare)
