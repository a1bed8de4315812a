"""Spatial join of points and zones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.geometry import with_box, within


def points_in_zones(points: DataFrame, zones: DataFrame, x: str, y: str, zone: str, rings: str = "rings", cell: float = 1.0, most_broadcast: int = 10_000) -> DataFrame:
    """points with the zone (or zones) they lie strictly within; null for points in none.

    Zones are cut into the grid cells of side `cell` that their bounds touch, so points meet only zones of their own
    cell, in an equi-join. What is sent to all executors is counted: up to 8 * most_broadcast corners of the zones'
    rings, each counted once a cell that its zone touches. More are shuffled by cell; points in a cell of many rows are left to
    adaptive execution to split.
    """
    names = points.columns
    boxed = with_box(zones.select(F.col(zone).alias("_zone"), F.col(rings).alias("_rings")), "_rings")
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
    cells = boxed.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))
    spans = (F.floor(F.col("xmax") / cell) - F.floor(F.col("xmin") / cell) + 1) * (F.floor(F.col("ymax") / cell) - F.floor(F.col("ymin") / cell) + 1)
    corners = boxed.agg(F.sum(spans.cast("double") * F.size(F.flatten("_rings")))).first()[0] or 0.0
    few = corners <= most_broadcast * 8
    keyed = points.withColumns({"_cx": F.floor(F.col(x) / cell).cast("long"), "_cy": F.floor(F.col(y) / cell).cast("long")})
    inside = (F.col("_x") >= F.col("xmin")) & (F.col("_x") <= F.col("xmax")) & (F.col("_y") >= F.col("ymin")) & (F.col("_y") <= F.col("ymax")) & within(F.col("_x"), F.col("_y"), F.col("_rings"))
    side = cells.withColumnsRenamed({"_cx": "_zx", "_cy": "_zy"})
    keyed = keyed.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    matched = keyed.join(F.broadcast(side) if few else side, (F.col("_cx") == F.col("_zx")) & (F.col("_cy") == F.col("_zy")) & inside, "left")
    return matched.select(*names, F.col("_zone").alias(zone))


def zone_counts(points: DataFrame, zones: DataFrame, x: str, y: str, zone: str, count: str, cell: float = 1.0) -> DataFrame:
    """All zones with the number of points within each, 0 for none."""
    found = points_in_zones(points, zones, x, y, zone, cell=cell).where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count("*").alias(count))
    return zones.select(zone).join(found, zone, "left").na.fill(0, [count])


def to_plane(lon, lat, lat0: float):
    """Local equirectangular metres around latitude lat0; within 0.1 % over a city."""
    scale = math.pi / 180 * 6_371_000
    return lon * scale * math.cos(math.radians(lat0)), lat * scale
