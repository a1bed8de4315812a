"""Streams run to their end over the given files, and online clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import labels
from larkspur.functions.numbers import rounded
from larkspur.operators import formats
from larkspur.operators.aggregates import share_within
from larkspur.plans.base import registrar, trips, trips_sql
from larkspur.plans.reports import _sql
from larkspur.sources.shared import own_path
from larkspur.sources.tables import load
from larkspur.streaming import windows

QUERIES, ORACLE_SQL, query = registrar()


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return windows.event_time(windows.replay(spark, f"{path}*", schema).drop("props"), "ts")


def _ran(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What the stream has written when it ends."""
    path = own_path(spark, name)
    windows.to_files(stream, path, own_path(spark, "offsets"), "parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"SELECT * FROM ({_sql(3600)}) WHERE window_end <= (SELECT max(ts) FROM events)")
def stream_tumbling_append(spark: SparkSession, sf: str) -> DataFrame:
    """Closed windows of the stream, as an append sink has them: all but those the watermark hasn't passed."""
    return _ran(spark, windows.tumbling(_stream(spark, sf), "1 hour", ["event_type"], ["value"]), "windows")


_MESSAGE = "event_id long, event_type string, value double, ts string"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """The events as keyed messages in order, replayed file by file, with one at the end that closes all windows."""
    path = own_path(spark, "messages")
    events = load(spark, sf, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    windows.ordered_messages(events, path, "event_id", ["ts", "event_id"], 4, last="ts")
    return windows.event_time(windows.opened(windows.replay(spark, path, windows.MESSAGES, form="json"), _MESSAGE), "ts")


@query(_sql(3600))
def stream_flushed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All windows, the last ones too, of a replay in order: none is late, none stays open.

    The closing message's own window goes afterwards: in the stream the filter would be pushed below the watermark.
    """
    return _ran(spark, windows.tumbling(_messages(spark, sf), "1 hour", ["event_type"], ["value"]), "windows").where("event_type IS NOT NULL")


@query("WITH w AS (" + _sql(3600) + ") " + " UNION ALL ".join(f"SELECT '{n}' AS implementation, count(*) AS records, sum(count)::BIGINT AS events, round(1e-9 + sum(value_mean * count) / sum(count), 3) AS value_mean FROM w" for n in ("stream", "batch")))
def stream_against_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Records, events and weighted mean of the stream's windows and of the batch's."""
    from larkspur.functions.numbers import weighted
    from larkspur.plans.reports import tumbling_stats_1h

    found = []
    for name, rows in (("stream", stream_flushed_windows(spark, sf)), ("batch", tumbling_stats_1h(spark, sf))):
        found.append(rows.agg(F.count("*").alias("records"), F.sum("count").alias("events"), rounded(weighted(F.col("value_mean"), F.col("count")), 3).alias("value_mean")).select(F.lit(name).alias("implementation"), "*"))
    return found[0].unionByName(found[1])


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Zone and borough by user."""
    zones = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, sf, "customer").join(zones, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"))


_SCALES = {"value": 100.0, "hour": 24.0}
_PAYLOAD = ("event_type", "ts", "user_id", "borough", "zone")


@query()
def stream_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """One model for all events of the stream: cluster, distance, time, source, user, borough, zone and features of each."""
    events = _stream(spark, sf).withColumn("hour", F.hour("ts").cast("double")).join(_placed(spark, sf), "user_id", "left")
    path = own_path(spark, "clusters")
    ran, schema = windows.kmeans_to_files(events, path, own_path(spark, "offsets"), 5, _SCALES, "event_id", _PAYLOAD)
    ran.awaitTermination()
    found = spark.read.schema(schema).parquet(f"{path}/rows/*")
    return found.where("kind = 'point'").drop("kind", "event_count", "count", "centre")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return windows.event_time(load(spark, sf, "events").drop("props"), "ts").withColumn("hour", F.hour("ts").cast("double"))


@query()
def kmeans_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return windows.kmeans_snapshots(_points(spark, sf), 5, _SCALES, ["ts", "event_id"], "event_type")


#: Centres that the parallel form assigns points to (scaled value and hour).
_CENTRES = ((0.2, 0.1), (0.2, 0.8), (0.8, 0.2), (0.8, 0.7), (1.5, 0.5))
_NEAREST = "p AS (SELECT event_id, user_id, event_type, coalesce(value, 0) AS value, hour(ts)::DOUBLE AS hour FROM events), d AS (SELECT *, [" + ", ".join(
    f"sqrt((value / 100 - {x}) ** 2 + (hour / 24 - {y}) ** 2)" for x, y in _CENTRES) + "] AS far FROM p), n AS (SELECT *, list_min(far) AS cluster_distance, (list_position(far, list_min(far)) - 1)::BIGINT AS cluster_id FROM d)"


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return windows.nearest_centres(_points(spark, sf), _CENTRES, _SCALES)


@query(f"WITH {_NEAREST} SELECT event_id, cluster_id, round(1e-9 + cluster_distance, 6) AS cluster_distance FROM n")
def nearest_centres(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select("event_id", "cluster_id", rounded(F.col("cluster_distance"), 6).alias("cluster_distance"))


@query(f"WITH {_NEAREST} SELECT event_type, cluster_id, count(*) AS count, round(1e-9 + avg(value), 6) AS value, round(1e-9 + avg(hour), 6) AS hour FROM n GROUP BY 1, 2")
def moved_centres(spark: SparkSession, sf: str) -> DataFrame:
    """The centres after one step of all points, by type."""
    found = windows.moved_centres(_nearest(spark, sf), _SCALES, "event_type")
    return found.withColumns({c: rounded(F.col(c), 6) for c in _SCALES})


_PLACES = "z AS (SELECT c_custkey AS user_id, r_name AS borough FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_NEAREST} SELECT event_type, cluster_id, count(*) AS n, round(1e-9 + count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type), 6) AS percent FROM n GROUP BY 1, 2")
def cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by source, in percent of the source's events."""
    counted = _nearest(spark, sf).groupBy("event_type", "cluster_id").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", rounded(share_within("n", "event_type"), 6))


@query(f"WITH {_NEAREST}, {_PLACES} SELECT cluster_id, borough, count(*) AS n FROM n LEFT JOIN z USING (user_id) GROUP BY 1, 2")
def cluster_boroughs(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by borough; events of unknown places count under none."""
    return _nearest(spark, sf).join(_placed(spark, sf), "user_id", "left").groupBy("cluster_id", "borough").agg(F.count("*").alias("n"))


_TRIPS = {"distance": 50.0, "fare": 100_000.0}
_TRIP_CENTRES = ((0.1, 0.1), (0.4, 0.3), (0.7, 0.5), (0.95, 0.9))


@query(trips_sql() + ", d AS (SELECT distance / 4 AS miles, fare / 1000 AS price, operator, [" + ", ".join(f"sqrt((distance / 50 - {x}) ** 2 + (fare / 100000 - {y}) ** 2)" for x, y in _TRIP_CENTRES) + """] AS far FROM trips),
    c AS (SELECT (list_position(far, list_min(far)) - 1)::BIGINT AS cluster_id, count(*) AS n, avg(miles) AS miles, avg(price) AS price, avg((operator = 'N')::INTEGER) AS share FROM d GROUP BY 1)
    SELECT cluster_id, n, CASE WHEN share < 0.5 THEN 'Yellow Taxi' WHEN share > 0.85 THEN 'FHVHV (Uber/Lyft)' ELSE 'Mixed' END || ', ' || CASE WHEN miles < 2 THEN 'short local' WHEN miles < 6 THEN 'medium' WHEN miles < 12 THEN 'long' ELSE 'airport/outer-borough' END
    || printf(' trip (~%.1f mi, ~$%.0f fare)', miles, price) AS label FROM c""")
def cluster_characterisation(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of trips by distance and fare, labelled by their mean miles and fare and the share of app-based trips."""
    found = windows.nearest_centres(trips(spark, sf), _TRIP_CENTRES, _TRIPS).groupBy("cluster_id")
    found = found.agg(F.count("*").alias("n"), F.avg(F.col("distance") / 4).alias("miles"), F.avg(F.col("fare") / 1000).alias("price"), F.avg((F.col("operator") == "N").cast("int")).alias("share"))
    return found.select("cluster_id", "n", labels.trip_label(F.col("miles"), F.col("price"), F.col("share")).alias("label"))


@query()
def format_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and read times of the events in several formats."""
    return formats.format_benchmark(load(spark, sf, "events"), own_path(spark, "formats"), runs=3)


@query()
def online_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    found = windows.online_kmeans(_points(spark, sf), 5, _SCALES, ["ts", "event_id"], ["event_id", "value"], "event_type")
    return found.withColumn("cluster_distance", F.round("cluster_distance", 6))
