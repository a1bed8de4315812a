"""Counts over time, fares, zones and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, labels, numbers
from larkspur.functions.numbers import rounded
from larkspur.operators import aggregates as agg
from larkspur.operators import quality
from larkspur.operators.enrich import mapped
from larkspur.plans.base import DO, PU, registrar, trips, trips_sql
from larkspur.sources.tables import load

QUERIES, ORACLE_SQL, query = registrar()
Y0, Y1 = 1996, 2000
#: operators' names by code.
OPERATORS = {"A": "Alpha", "N": "North", "R": "Rapid"}
SERVICES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _cube(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(F.col("o_orderdate").alias("pickup"), F.col("o_orderpriority").alias("service"))
    return agg.temporal_cube(dates.year_between(orders, "pickup", Y0, Y1), "pickup")


@query("SELECT year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, hour(ts)::INTEGER AS hour, dayofweek(ts)::INTEGER AS dow, count(*) AS trips FROM events WHERE ts IS NOT NULL AND year(ts) BETWEEN 2023 AND 2025 GROUP BY 1, 2, 3, 4")
def temporal_cube(spark: SparkSession, sf: str) -> DataFrame:
    return agg.temporal_cube(dates.year_between(load(spark, sf, "events"), "ts", 2023, 2025), "ts")


@query(f"SELECT year(o_orderdate)::INTEGER AS year, count(*) AS trips FROM orders WHERE year(o_orderdate) BETWEEN {Y0} AND {Y1} GROUP BY 1")
def yearly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return agg.roll_up(_cube(spark, sf), "year").select("year", F.col("trips").cast("long").alias("trips"))


@query(f"SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*) AS trips FROM orders WHERE year(o_orderdate) BETWEEN {Y0} AND {Y1} GROUP BY 1")
def monthly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return agg.monthly(_cube(spark, sf))


@query("SELECT hour(ts)::INTEGER AS hour, count(*) AS trips FROM events GROUP BY 1")
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("trips"))


@query(f"SELECT dayofweek(o_orderdate)::INTEGER AS dow, count(*) AS trips FROM orders WHERE year(o_orderdate) BETWEEN {Y0} AND {Y1} GROUP BY 1")
def dow_trips(spark: SparkSession, sf: str) -> DataFrame:
    return agg.roll_up(_cube(spark, sf), "dow")


@query("""SELECT year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, hour(ts)::INTEGER AS hour, dayofweek(ts)::INTEGER AS dow, count(*) AS trips
    FROM events GROUP BY GROUPING SETS ((year(ts)), (year(ts), month(ts)), (hour(ts)), (dayofweek(ts)))""")
def temporal_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """All roll-ups of the cube from one scan; the sets expand the cube, not the events."""
    cube = agg.temporal_cube(load(spark, sf, "events"), "ts")
    year, month, hour, dow = (F.col(c) for c in ("year", "month", "hour", "dow"))
    return cube.groupingSets([[year], [year, month], [hour], [dow]], year, month, hour, dow).agg(F.sum("trips").alias("trips"))


@query("SELECT year(o_orderdate)::INTEGER AS year, " + ", ".join(f"sum(CASE WHEN o_orderpriority = '{s}' THEN 1 END)::BIGINT AS \"{s}\"" for s in SERVICES) + " FROM orders GROUP BY 1")
def service_columns_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderpriority", list(SERVICES)).agg(F.count(F.lit(1))).select("year", *[F.when(F.col(s) > 0, F.col(s)).alias(s) for s in SERVICES])


_BUCKETS = trips_sql(PU) + """, b AS (SELECT year(pickup)::INTEGER AS year, pu_zone, (floor(fare / 5000) * 5000)::BIGINT AS fare_bucket,
    avg(fare) AS avg_fare, avg(distance) AS avg_dist, count(*) AS trips FROM trips WHERE fare > 0 AND distance > 0 GROUP BY 1, 2, 3)"""


def _fares(spark: SparkSession, sf: str) -> DataFrame:
    rows = trips(spark, sf, PU).where(numbers.positive(F.col("fare")) & numbers.positive(F.col("distance")))
    by = [F.year("pickup").alias("year"), "pu_zone", numbers.bucket(F.col("fare"), 5000).alias("fare_bucket")]
    return rows.groupBy(*by).agg(F.avg("fare").alias("avg_fare"), F.avg("distance").alias("avg_dist"), F.count("*").alias("trips"))


@query(_BUCKETS + " SELECT year, pu_zone, fare_bucket, round(1e-9 + avg_fare, 4) AS avg_fare, round(1e-9 + avg_dist, 4) AS avg_dist, trips FROM b")
def fare_by_year_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return _fares(spark, sf).withColumns({c: rounded(F.col(c), 4) for c in ("avg_fare", "avg_dist")})


@query(_BUCKETS + " SELECT year, round(1e-9 + sum(avg_fare * trips) / sum(trips), 4) AS avg_fare, round(1e-9 + sum(avg_dist * trips) / sum(trips), 4) AS avg_dist, sum(trips)::BIGINT AS trips FROM b GROUP BY 1")
def weighted_fare_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return agg.weighted_means(_fares(spark, sf), ["year"], "trips", ["avg_fare", "avg_dist"]).withColumns({c: rounded(F.col(c), 4) for c in ("avg_fare", "avg_dist")})


@query(_BUCKETS + " SELECT fare_bucket, sum(trips)::BIGINT AS trips FROM b WHERE fare_bucket BETWEEN 0 AND 50000 GROUP BY 1")
def fare_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _fares(spark, sf).where(F.col("fare_bucket").between(0, 50000)).groupBy("fare_bucket").agg(F.sum("trips").alias("trips"))


def _zone_counts(spark: SparkSession, sf: str, zone: str) -> DataFrame:
    return trips(spark, sf, zone[:2]).where(F.col(zone).isNotNull()).groupBy(F.col(zone).cast("long").alias("zone")).agg(F.count("*").alias("trips"))


@query(trips_sql(PU) + " SELECT pu_zone::BIGINT AS zone, count(*) AS trips FROM trips WHERE pu_zone IS NOT NULL GROUP BY 1")
def zone_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _zone_counts(spark, sf, "pu_zone")


@query(trips_sql(PU) + " SELECT pu_zone::BIGINT AS zone, count(*) AS trips FROM trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_pickup_zones(spark: SparkSession, sf: str) -> DataFrame:
    return agg.top(_zone_counts(spark, sf, "pu_zone"), "trips", 10, "zone")


@query(trips_sql(DO) + " SELECT do_zone::BIGINT AS zone, count(*) AS trips FROM trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_dropoff_zones(spark: SparkSession, sf: str) -> DataFrame:
    return agg.top(_zone_counts(spark, sf, "do_zone"), "trips", 10, "zone")


@query(trips_sql(PU) + """ SELECT r_name AS borough, sum(coalesce(trips, 0))::BIGINT AS trips, round(1e-9 + 100.0::DOUBLE * sum(coalesce(trips, 0)) / sum(sum(coalesce(trips, 0))) OVER (), 4) AS percent
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT pu_zone, count(*) AS trips FROM trips GROUP BY 1) ON n_nationkey = pu_zone GROUP BY 1""")
def region_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Zones with and without trips, summed by borough; the percentage window spans the boroughs alone."""
    zones = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = zones.join(_zone_counts(spark, sf, "pu_zone"), F.col("n_nationkey") == F.col("zone"), "left").na.fill(0, ["trips"])
    return counted.groupBy(F.col("r_name").alias("borough")).agg(F.sum("trips").alias("trips")).withColumn("percent", rounded(agg.share_within("trips"), 4))


@query(trips_sql() + """ SELECT year(pickup)::INTEGER AS year, CASE operator WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'North' WHEN 'R' THEN 'Rapid' ELSE 'Other' END AS company,
    count(*) AS trips, sum(CASE WHEN shared IN ('O', '1') THEN 1 ELSE 0 END)::BIGINT AS shared FROM trips GROUP BY 1, 2""")
def operator_conditional_sum(spark: SparkSession, sf: str) -> DataFrame:
    rows = trips(spark, sf).groupBy(F.year("pickup").alias("year"), "operator").agg(F.count("*").alias("trips"), F.count_if(F.col("shared").isin("O", "1")).alias("shared"))
    return rows.select("year", mapped(F.col("operator"), OPERATORS, "Other").alias("company"), "trips", "shared")


@query(trips_sql(PU, DO) + """ SELECT zone, sum(n)::BIGINT AS total FROM (SELECT pu_zone::BIGINT AS zone, count(*) AS n FROM trips GROUP BY 1
    UNION ALL SELECT do_zone::BIGINT, count(*) FROM trips GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_locations_union(spark: SparkSession, sf: str) -> DataFrame:
    """Pickups and dropoffs by zone from one scan: both zones of a trip, exploded."""
    ends = trips(spark, sf, PU, DO).select(F.explode(F.array(F.col("pu_zone").cast("long"), F.col("do_zone").cast("long"))).alias("zone"))
    return agg.top(ends.groupBy("zone").agg(F.count("*").alias("total")), "total", 10, "zone")


_QUALITY = trips_sql() + """, f AS (SELECT *, 1998 AS file_year, coalesce(year(pickup), 1998)::INTEGER AS year, (dropoff IS NOT NULL AND dropoff <> TIMESTAMP '1989-01-01') AS ok FROM trips),
q AS (SELECT service, year, count(*) AS total_rows, """ + ", ".join(f"(count(*) FILTER ({cond}))::BIGINT AS {name}" for name, cond in {
    "invalid_year": "abs(year - file_year) > 1", "null_pickup": "pickup IS NULL", "null_dropoff": "dropoff IS NULL", "placeholder_dropoff": "dropoff = TIMESTAMP '1989-01-01'",
    "same_timestamps": "ok AND pickup = dropoff", "negative_duration": "ok AND dropoff < pickup", "excessive_duration": "ok AND dropoff > pickup + INTERVAL 24 HOUR",
    "zero_distance": "distance = 0", "negative_distance": "distance < 0", "zero_passengers": "passengers = 0", "negative_fare": "fare < 0", "high_fare": "fare > 500 AND NOT isnan(fare)"}.items()) + " FROM f GROUP BY 1, 2)"
_ISSUES = " + ".join(quality.ISSUES)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_by_year(trips(spark, sf).withColumn("file_year", F.lit(1998)), "service")


@query(_QUALITY + " SELECT * FROM q")
def quality_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@query(_QUALITY + f""" SELECT service, year, total_rows, ({_ISSUES})::BIGINT AS total_issues, round(1e-9 + ({_ISSUES})::DOUBLE / total_rows * 100, 4) AS issue_rate,
    CASE WHEN ({_ISSUES}) * 100.0 / total_rows > 5 THEN 'high' WHEN ({_ISSUES}) * 100.0 / total_rows > 1 THEN 'medium' WHEN ({_ISSUES}) > 0 THEN 'low' ELSE 'none' END AS severity FROM q""")
def quality_rates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.with_rates(_report(spark, sf)).select("service", "year", "total_rows", "total_issues", "issue_rate", "severity")


@query(_QUALITY + " SELECT service, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("total_rows", *quality.ISSUES)) + " FROM q GROUP BY 1")
def quality_overall(spark: SparkSession, sf: str) -> DataFrame:
    return quality.overall(_report(spark, sf), "service")


@query(_QUALITY + ", t AS (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in quality.ISSUES) + " FROM q) " + " UNION ALL ".join(f"SELECT '{c}' AS issue, {c}::BIGINT AS found FROM t WHERE {c} > 0" for c in quality.ISSUES))
def active_issue_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Checks that found anything, as rows: a wide row unpivoted."""
    wide = quality.overall(_report(spark, sf))
    return wide.unpivot([], list(quality.ISSUES), "issue", "found").where("found > 0")


@query(trips_sql() + " SELECT trip_id, count(*) AS n, sum(fare + 2 * coalesce(tip, 0))::DECIMAL(20, 2)::DOUBLE AS total FROM trips WHERE dropoff > pickup AND distance > 0 AND distance < 40 AND fare >= 0 AND fare BETWEEN 0 AND 50000 AND year(pickup) = 1998 GROUP BY 1")
def stream_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = trips(spark, sf).where((c("dropoff") > c("pickup")) & (c("distance") > 0) & (c("distance") < 40) & (c("fare") >= 0) & c("fare").between(0, 50000))
    return dates.year_between(rows, "pickup", 1998, 1998).groupBy("trip_id").agg(F.count("*").alias("n"), F.sum(c("fare") + 2 * F.coalesce(c("tip"), F.lit(0.0))).cast("decimal(20,2)").cast("double").alias("total"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without line items, as wanted files that aren't there."""
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(lines, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, (epoch(date_trunc('minute', l_shipdate)) / 60 - epoch(date_trunc('minute', o_orderdate)) / 60)::BIGINT AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def minute_date_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", dates.minute_boundaries(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes"))


@query(trips_sql() + """, a AS (SELECT service, avg(fare) AS fare, avg(distance) AS distance FROM trips WHERE year(pickup) = 1996 GROUP BY 1), b AS (SELECT service, avg(fare) AS fare, avg(distance) AS distance FROM trips WHERE year(pickup) = 1997 GROUP BY 1)
    SELECT a.service, round(1e-9 + a.fare, 4) AS fare_base, round(1e-9 + b.fare, 4) AS fare_new, round(1e-9 + (a.fare - b.fare) / a.fare * 100, 4) AS fare_gain,
    round(1e-9 + a.distance, 4) AS distance_base, round(1e-9 + b.distance, 4) AS distance_new, round(1e-9 + (a.distance - b.distance) / a.distance * 100, 4) AS distance_gain FROM a JOIN b ON a.service = b.service""")
def metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two years' means side by side, with the change in percent."""
    both = dates.year_between(trips(spark, sf), "pickup", 1996, 1997).groupBy("service", F.year("pickup").alias("year")).agg(F.avg("fare").alias("fare"), F.avg("distance").alias("distance"))
    found = agg.paired(both.where("year = 1996"), both.where("year = 1997"), "service", ["fare", "distance"])
    return found.withColumns({c: rounded(F.col(c), 4) for c in found.columns if c != "service"})


@query(trips_sql() + """, t AS (SELECT trip_id, distance / 4 AS miles, fare / 1000 AS fare, tip * 10 AS share FROM trips)
    SELECT trip_id, count(*) AS n, CASE WHEN share < 0.5 THEN 'Yellow Taxi' WHEN share > 0.85 THEN 'FHVHV (Uber/Lyft)' ELSE 'Mixed' END AS vehicle,
    CASE WHEN miles < 2 THEN 'short local' WHEN miles < 6 THEN 'medium' WHEN miles < 12 THEN 'long' ELSE 'airport/outer-borough' END AS trip_type FROM t GROUP BY ALL""")
def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = trips(spark, sf).select("trip_id", labels.vehicle(F.col("tip") * 10).alias("vehicle"), labels.trip_type(F.col("distance") / 4).alias("trip_type"))
    return rows.groupBy("trip_id", "vehicle", "trip_type").agg(F.count("*").alias("n"))


@query(trips_sql(PU, DO) + " SELECT pu_zone, do_zone, count(*) AS trips, round(1e-9 + count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY pu_zone), 4) AS percent FROM trips GROUP BY 1, 2")
def zone_pair_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows between zones, in percent of the trips that start in a zone."""
    rows = trips(spark, sf, PU, DO).groupBy("pu_zone", "do_zone").agg(F.count("*").alias("trips"))
    return rows.withColumn("percent", rounded(agg.share_within("trips", "pu_zone"), 4))


@query(trips_sql() + " SELECT service, date_trunc('month', pickup)::DATE AS date, count(*) AS trips, count(*) FILTER (month(pickup) BETWEEN 3 AND 6) AS spring FROM trips WHERE year(pickup) BETWEEN 1997 AND 1999 GROUP BY 1, 2")
def period_months(spark: SparkSession, sf: str) -> DataFrame:
    """Months of a period by service, a part of each year set apart."""
    rows = dates.year_between(trips(spark, sf), "pickup", 1997, 1999)
    return rows.groupBy("service", F.trunc(F.col("pickup").cast("date"), "month").alias("date")).agg(F.count("*").alias("trips"), F.count_if(F.month("pickup").between(3, 6)).alias("spring"))
