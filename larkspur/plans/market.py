"""Market shares by month, pivots, and trends against a base month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import numbers
from larkspur.functions.numbers import rounded
from larkspur.operators import aggregates as agg
from larkspur.operators import enrich
from larkspur.plans.base import registrar, trips, trips_sql
from larkspur.plans.trips import OPERATORS, SERVICES

QUERIES, ORACLE_SQL, query = registrar()
NAMES = dict(zip(SERVICES, ("urgent", "high", "medium", "plain", "low")))
FIRMS = ("Alpha", "North", "Rapid", "Other")

_MONTHS = trips_sql() + ", t AS (SELECT date_trunc('month', pickup)::DATE AS date, service, operator FROM trips WHERE pickup IS NOT NULL), m AS (SELECT date, " + ", ".join(
    f"count(*) FILTER (service = '{s}') AS {n}" for s, n in NAMES.items()) + ", " + ", ".join(f"count(*) FILTER (operator = '{c}') AS {f}" for c, f in OPERATORS.items()) + ", 0::BIGINT AS Other FROM t GROUP BY 1)"


def _month() -> F.Column:
    return F.trunc(F.col("pickup").cast("date"), "month").alias("date")


def _cube(spark: SparkSession, sf: str) -> DataFrame:
    """Trips by month, service and operator; all that is below it is scanned and shuffled once, however often it is used."""
    return trips(spark, sf).groupBy(_month(), "service", "operator").agg(F.count("*").alias("trips"))


def _services(cube: DataFrame) -> list[DataFrame]:
    rows = cube.groupBy("date", "service").agg(F.sum("trips").alias("trips"))
    return [rows.where(F.col("service") == s).select("date", F.col("trips").alias(n)) for s, n in NAMES.items()]


def _operators(cube: DataFrame) -> DataFrame:
    """One column for each firm, those without trips included."""
    rows = cube.withColumn("company", enrich.mapped(F.col("operator"), OPERATORS, "Other"))
    return enrich.columns_by(rows, "date", "company", FIRMS, "trips").na.fill(0)


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    """Services and operators by month. The services' columns come by one pivot, which is the chain of outer joins."""
    cube = _cube(spark, sf)
    services = enrich.columns_by(cube, "date", "service", SERVICES, "trips").na.fill(0).withColumnsRenamed(NAMES)
    out = enrich.outer_chain([services, _operators(cube)], "date")
    return out.withColumns({"large": F.col("Alpha") + F.col("North"), "small": F.col("Rapid") + F.col("Other"), "all_total": sum((F.col(n) for n in NAMES.values()), F.lit(0)).cast("long")})


@query(_MONTHS + " SELECT date, " + ", ".join(NAMES.values()) + " FROM m")
def monthly_outer_chain(spark: SparkSession, sf: str) -> DataFrame:
    """One table for each service, joined on all their dates."""
    return enrich.outer_chain(_services(_cube(spark, sf)), "date")


@query(_MONTHS + " SELECT date, Alpha, North, Rapid, Other FROM m")
def operator_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _operators(_cube(spark, sf))


@query(_MONTHS + " SELECT *, Alpha + North AS large, Rapid + Other AS small, urgent + high + medium + plain + low AS all_total FROM m")
def monthly_combined(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf)


@query(_MONTHS + ", w AS (SELECT *, urgent + high + medium + plain + low AS total FROM m) SELECT date, " + ", ".join(f"round(1e-9 + coalesce({c}::DOUBLE / nullif(total, 0) * 100, 0), 6) AS {c}_share" for c in (*NAMES.values(), *FIRMS)) + " FROM w")
def market_share(spark: SparkSession, sf: str) -> DataFrame:
    columns = (*NAMES.values(), *FIRMS)
    return agg.shares(_combined(spark, sf), columns, "all_total").select("date", *[rounded(F.col(f"{c}_share"), 6).alias(f"{c}_share") for c in columns])


@query(_MONTHS + ", b AS (SELECT " + ", ".join(f"greatest(max({c}), 1)::DOUBLE AS {c}" for c in (*NAMES.values(), "Other")) + " FROM m WHERE date = DATE '1996-01-01') SELECT m.date, " + ", ".join(f"round(1e-9 + m.{c}::DOUBLE / b.{c} * 100, 6) AS {c}_index" for c in (*NAMES.values(), "Other")) + " FROM m, b")
def indexed_trend(spark: SparkSession, sf: str) -> DataFrame:
    columns = (*NAMES.values(), "Other")
    found = agg.indexed(_combined(spark, sf), "date", "1996-01-01", columns)
    return found.select("date", *[rounded(F.col(f"{c}_index"), 6).alias(f"{c}_index") for c in columns])


@query(_MONTHS + " SELECT date, round(1e-9 + coalesce((Rapid + Other)::DOUBLE / nullif(Alpha + North + Rapid + Other, 0) * 100, 0), 6) AS small_share FROM m")
def small_operator_share(spark: SparkSession, sf: str) -> DataFrame:
    found = _combined(spark, sf)
    return found.select("date", rounded(numbers.share(F.col("small"), F.col("small") + F.col("large")), 6).alias("small_share"))


@query(_MONTHS + ", d AS (SELECT abs((urgent + high + medium + plain + low) - (Alpha + North + Rapid + Other))::DOUBLE / (urgent + high + medium + plain + low) * 100 AS diff, date FROM m) SELECT median(diff) AS median_diff, min(date) AS first, max(date) AS last, count(*) AS months FROM d")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """How far the operators' sum is from the services', in percent, over all months."""
    total, firms = F.col("all_total"), sum((F.col(f) for f in FIRMS), F.lit(0))
    return _combined(spark, sf).select("date", (F.abs(total - firms).cast("double") / F.nullif(total, F.lit(0)) * 100).alias("diff")).agg(
        F.median("diff").alias("median_diff"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("months"))


@query(trips_sql() + """, n AS (SELECT operator, service, count(*) AS n FROM trips GROUP BY 1, 2), p AS (SELECT operator, service, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY operator) AS percent FROM n)
    SELECT operator, """ + ", ".join(f"round(1e-9 + max(percent) FILTER (service = '{s}'), 6) AS {n}" for s, n in NAMES.items()) + " FROM p GROUP BY 1")
def cluster_share(spark: SparkSession, sf: str) -> DataFrame:
    """Services in percent of each operator's trips, as columns."""
    rows = trips(spark, sf).groupBy("operator", "service").agg(F.count("*").alias("n"))
    wide = rows.withColumn("percent", rounded(agg.share_within("n", "operator"), 6)).groupBy("operator").pivot("service", list(SERVICES)).agg(F.max("percent"))
    return wide.withColumnsRenamed(NAMES)


@query(trips_sql() + " SELECT year(pickup)::INTEGER AS year, " + ", ".join(f"count(*) FILTER (operator = '{c}') AS {f}_trips, round(1e-9 + avg(fare) FILTER (operator = '{c}'), 4) AS {f}_fare" for c, f in OPERATORS.items()) + " FROM trips GROUP BY 1")
def multi_level_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Two aggregates for each operator, with flat names."""
    wide = trips(spark, sf).withColumn("year", F.year("pickup")).groupBy("year").pivot("operator", list(OPERATORS)).agg(F.count(F.lit(1)).alias("trips"), rounded(F.avg("fare"), 4).alias("fare"))
    return wide.select("year", *[c for code, f in OPERATORS.items() for c in (F.coalesce(f"{code}_trips", F.lit(0)).alias(f"{f}_trips"), F.col(f"{code}_fare").alias(f"{f}_fare"))])


@query(_MONTHS + ", y AS (SELECT year(date)::INTEGER AS year, sum(urgent)::BIGINT AS trips FROM m GROUP BY 1) SELECT year, trips, round(1e-9 + trips::DOUBLE / first_value(trips) OVER (ORDER BY year), 6) AS speedup FROM y")
def ratio_to_first(spark: SparkSession, sf: str) -> DataFrame:
    """Each year against the first: the base is one row, found by min_by, not by a window over all rows."""
    years = _combined(spark, sf).groupBy(F.year("date").alias("year")).agg(F.sum("urgent").alias("trips"))
    base = years.agg(F.min_by("trips", "year").alias("_first"))
    return years.join(F.broadcast(base)).select("year", "trips", rounded(F.col("trips").cast("double") / F.col("_first"), 6).alias("speedup"))
