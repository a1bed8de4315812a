"""Points in polygons, with rings as array<struct<x,y>>, and what planes need of WKT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def wkt_rings(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text; holes are rings like any other. Null if there is none."""
    body = F.regexp_replace(F.upper(text), r"[^0-9E+\-. ,()]", "")
    rings = F.filter(F.split(body, r"\)"), lambda r: F.length(F.regexp_replace(r, r"[ ,(]", "")) > 0)
    clean = lambda r: F.regexp_replace(F.trim(F.regexp_replace(r, r"[(]", "")), r"^,\s*", "")
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y"))
    out = F.transform(rings, lambda r: F.transform(F.split(F.trim(clean(r)), ","), point))
    return F.when(text.isNotNull() & (F.size(rings) > 0), out)


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))


def _crossings(x: Column, y: Column, ring: Column) -> Column:
    def crosses(e: Column) -> Column:
        spans = (e.ay > y) != (e.by > y)
        at = (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax
        return (spans & (x < at)).cast("int")

    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + F.coalesce(crosses(e), F.lit(0)))


def _on_edge(x: Column, y: Column, ring: Column) -> Column:
    def on(e: Column) -> Column:
        turn = (e.bx - e.ax) * (y - e.ay) - (e.by - e.ay) * (x - e.ax)
        return (turn == 0) & x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))

    return F.exists(_edges(ring), on)


def within(x: Column, y: Column, rings: Column) -> Column:
    """Strictly inside: an odd number of crossings over all rings, and on none of their edges."""
    crossed = F.aggregate(rings, F.lit(0), lambda n, r: n + _crossings(x, y, r))
    return (crossed % 2 == 1) & ~F.exists(rings, lambda r: _on_edge(x, y, r))


def centroid(ring: Column) -> Column:
    """Area-weighted centroid of a simple ring, as struct<x,y>."""
    cross = lambda e: e.ax * e.by - e.bx * e.ay
    total = lambda f: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + f(e))
    area = F.nullif(total(cross) * 3, F.lit(0.0))
    return F.struct((total(lambda e: (e.ax + e.bx) * cross(e)) / area).alias("x"), (total(lambda e: (e.ay + e.by) * cross(e)) / area).alias("y"))


def with_box(zones: DataFrame, rings: str = "rings") -> DataFrame:
    """zones with the bounds of their rings: xmin, xmax, ymin, ymax."""
    points = F.flatten(rings)
    x, y = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return zones.withColumns({"xmin": F.array_min(x), "xmax": F.array_max(x), "ymin": F.array_min(y), "ymax": F.array_max(y)})
