"""Files written and read again, drifting schemas, text and calendar expressions: each with the rows it must give.

What is written goes to a folder that the driver and the executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, numbers, texts
from larkspur.operators import quality
from larkspur.plans.base import registrar, trips, trips_sql
from larkspur.plans.trips import Y0, Y1
from larkspur.sources import schema, sinks, tables
from larkspur.sources.shared import own_path
from larkspur.sources.tables import load

QUERIES, ORACLE_SQL, query = registrar()

_PLAIN = "SELECT event_id, user_id, event_type, value FROM events"


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query(_PLAIN)
def csv_gzip_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = _plain(spark, sf), own_path(spark, "csv")
    sinks.write_csv(rows, path, gzip=True, one_file=False)
    return tables.read_csv(spark, path, rows.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_inferred_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A small lookup as one file with a header, its types inferred."""
    path = own_path(spark, "csv")
    sinks.write_csv(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return tables.read_csv(spark, path).withColumns({c: F.col(c).cast("int") for c in ("n_nationkey", "n_regionkey")})


@query(_PLAIN)
def ndjson_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = _plain(spark, sf), own_path(spark, "json")
    sinks.write_json(rows, path)
    return tables.read_ndjson(spark, path, rows.schema)


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def json_document_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """One document that is a list of records."""
    path = own_path(spark, "document")
    records = load(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    records.agg(F.to_json(F.collect_list(F.struct("key", "name"))).alias("value")).coalesce(1).write.text(path)
    return tables.read_json_documents(spark, path, records.schema)


@query(f"SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN {Y0} AND {Y1} GROUP BY 1")
def partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Folders by year, of which the years asked for are read; a year with many rows is several tasks'."""
    path = own_path(spark, "years")
    sinks.write_partitioned(load(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), path, files_per_value=2)
    rows = tables.partitions_between(spark, path, Y0, Y1)
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
def ordered_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Files in order: a row's place follows from its file's rows before it and its place there.

    The counts before a file come from a window over files, not over rows.
    """
    from pyspark.sql import Window

    path = own_path(spark, "ordered")
    sinks.write_ordered(load(spark, sf, "events").select("event_id", "ts"), path, "ts", "event_id")
    rows = spark.read.parquet(path).select("event_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("index"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "file").select("event_id", (F.col("before") + F.col("index")).alias("place"))


@query("SELECT count(*) AS n, 1::BIGINT AS files FROM nation")
def row_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the files' footers alone."""
    path = own_path(spark, "footers")
    sinks.write_ordered(load(spark, sf, "nation"), path, "n_nationkey", one_file=True)
    files = spark.read.parquet(path).inputFiles()
    return tables.row_groups(spark, files).agg(F.sum("rows").alias("n"), F.count("*").alias("files"))


def _drifting(spark: SparkSession, sf: str) -> list[str]:
    """Events by type in files whose schemas drift: a column renamed, one missing, one of another type, one more."""
    rows, folder = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts"), own_path(spark, "drift")
    kinds = {
        "feed_a_2023.parquet": rows.where("event_id % 3 = 0"),
        "feed_a_2024.parquet": rows.where("event_id % 3 = 1").withColumn("user_id", F.col("user_id").cast("double")).drop("value"),
        "feed_a_2025.parquet": rows.where("event_id % 3 = 2").withColumn("event_type", F.lit("x")).withColumn("extra", F.col("event_id").cast("int")),
    }
    for name, some in kinds.items():
        some.write.parquet(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in kinds]


@query("SELECT event_id, user_id::DOUBLE AS user_id, CASE WHEN event_id % 3 = 2 THEN 'x' ELSE event_type END AS event_type, CASE WHEN event_id % 3 <> 1 THEN value END AS value, ts, CASE WHEN event_id % 3 = 2 THEN event_id::INTEGER END AS extra FROM events")
def drifting_union(spark: SparkSession, sf: str) -> DataFrame:
    """Files of three schemas as one table: types promoted, missing columns null."""
    return schema.read_drifting(spark, _drifting(spark, sf))


_REPORT = {
    "feed_a_2023.parquet": {"event_id": "same", "user_id": "same", "event_type": "same", "value": "same", "ts": "same"},
    "feed_a_2024.parquet": {"event_id": "same", "user_id": "dtype_mismatch", "event_type": "same", "value": "missing", "ts": "same"},
    "feed_a_2025.parquet": {"event_id": "same", "user_id": "same", "event_type": "same", "value": "same", "ts": "same", "extra": "extra"},
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', 'feed_a', '{c}', '{s}')" for f, found in _REPORT.items() for c, s in found.items()) + ") v(file, prefix, \"column\", status)")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    found = schema.schema_report(spark, _drifting(spark, sf))
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "prefix", "column", "status")


@query("SELECT 3::BIGINT AS schemas, 3::BIGINT AS files, false AS consistent")
def distinct_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """How many different sets of columns and types the files have."""
    found = schema.schema_report(spark, _drifting(spark, sf)).where("status NOT IN ('missing', 'error')")
    by_file = found.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "column", "type"))), ",").alias("schema"))
    return by_file.agg(F.count_distinct("schema").alias("schemas"), F.count("*").alias("files")).withColumn("consistent", F.col("schemas") == 1)


@query("""SELECT event_id AS trip_id, ts AS pickup, CASE WHEN event_id % 2 = 0 THEN value ELSE user_id END::DOUBLE AS amount, NULL::VARCHAR AS note, coalesce(year(ts), 2024)::INTEGER AS year FROM events""")
def normalised_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Old names under canonical ones, the first value that isn't null, cast, null where missing, and a year."""
    from pyspark.sql import types as T

    rows = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("ID"), F.col("ts").alias("Trip_Pickup"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("amt"), F.col("user_id").alias("Amount_2"), F.lit("y").alias("junk"))
    names = {"ID": "trip_id", "Trip_Pickup": "pickup", "amt": "amount", "Amount_2": "amount"}
    kind = load(spark, sf, "events").schema["ts"].dataType
    target = T.StructType([T.StructField("trip_id", T.LongType()), T.StructField("pickup", kind), T.StructField("amount", T.DoubleType()), T.StructField("note", T.StringType())])
    return schema.normalise(rows, names, target, "pickup", 2024, drop=["junk"])


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS file_year FROM orders")
def file_years(spark: SparkSession, sf: str) -> DataFrame:
    """A year from each file's name or the nearest folder above it."""
    path = own_path(spark, "files")
    rows = load(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("trips"))
    rows.write.partitionBy("trips").parquet(path)
    return schema.with_file_year(spark.read.parquet(path)).select("o_orderkey", "file_year")


@query("WITH m AS (SELECT unnest(generate_series(DATE '1992-01-01', DATE '1998-12-01', INTERVAL 1 MONTH))::DATE AS month), h AS (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE o_orderkey % 100 = 0 GROUP BY 1) SELECT month FROM m WHERE month NOT IN (SELECT month FROM h)")
def missing_months(spark: SparkSession, sf: str) -> DataFrame:
    """Months of a period without a file, where a hundredth of the orders stand for files."""
    have = load(spark, sf, "orders").where("o_orderkey % 100 = 0").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).distinct()
    return schema.missing_names(dates.months(spark, "1992-01-01", "1998-12-01"), have, "month")


_PATH = "'/data/' || lower(replace(o_orderpriority, ' ', '_')) || '/trips_' || year(o_orderdate) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '.parquet'"


@query(f"""WITH p AS (SELECT o_orderkey, {_PATH} AS path FROM orders) SELECT o_orderkey, path, regexp_extract(path, '([0-9]-[a-z_]+)/', 1) AS service, left(replace(replace(path, '/', '_'), '-', '_'), 20) AS label,
    ends_with(path, '-01.parquet') AS january, contains(path, 'urgent') AS urgent, o_orderkey % 2 = 0 AND contains(path, 'urgent') AS marked FROM p""")
def text_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Names with padded months, the service in them, labels without odd characters and cut, predicates on both."""
    ts = F.col("o_orderdate")
    path = F.concat(F.lit("/data/"), F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))), F.lit("/trips_"), texts.year_month(ts), F.lit(".parquet"))
    rows = load(spark, sf, "orders").select("o_orderkey", path.alias("path"))
    return rows.select("o_orderkey", "path", texts.found(F.col("path"), r"([0-9]-[a-z_]+)/").alias("service"), texts.label(F.col("path"), 20).alias("label"), F.col("path").endswith("-01.parquet").alias("january"), F.col("path").contains("urgent").alias("urgent"), ((F.col("o_orderkey") % 2 == 0) & F.col("path").contains("urgent")).alias("marked"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, (epoch_us(ts) // 1000)::BIGINT AS millis, strftime(ts, '%d.%m.%Y') AS shown, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def time_texts(spark: SparkSession, sf: str) -> DataFrame:
    """ISO texts and epoch milliseconds, and a day parsed from a text by its pattern."""
    ts = F.col("ts")
    rows = load(spark, sf, "events").select("event_id", dates.iso(ts).alias("iso"), dates.epoch_ms(ts).alias("millis"), F.date_format(ts, "dd.MM.yyyy").alias("shown"))
    return rows.withColumn("day", dates.parsed(F.col("shown"), "dd.MM.yyyy").cast("timestamp_ntz"))


@query(trips_sql() + " SELECT CASE WHEN year(pickup) BETWEEN 1992 AND 1996 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT year(pickup)) AS years FROM trips WHERE year(pickup) BETWEEN 1992 AND 1997 GROUP BY 1")
def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    """Years to learn from and the year to test on, as ranges that reach the scan."""
    parts = [("train", 1992, 1996), ("test", 1997, 1997)]
    found = [dates.year_between(trips(spark, sf), "pickup", a, b).agg(F.count("*").alias("n"), F.count_distinct(F.year("pickup")).alias("years")).select(F.lit(n).alias("part"), "*") for n, a, b in parts]
    return found[0].unionByName(found[1])


@query(trips_sql() + " SELECT service, CASE WHEN count(*) = 0 THEN '—' ELSE format('{:,}', count(*)) END AS shown FROM trips GROUP BY 1")
def shown_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = trips(spark, sf).groupBy("service").agg(F.count("*").alias("n"))
    return counted.select("service", numbers.shown_count(F.col("n")).alias("shown"))


@query(trips_sql() + " SELECT list_sort(list(c)) AS issues FROM (SELECT unnest(['negative_duration', 'high_fare', 'null_pickup']) AS c, unnest([count(*) FILTER (dropoff < pickup AND dropoff IS NOT NULL), count(*) FILTER (fare > 500), count(*) FILTER (pickup IS NULL)]) AS n FROM trips) WHERE n > 0")
def active_issue_names(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three checks found anything, by one aggregation."""
    report = quality.quality_by_year(trips(spark, sf).withColumn("file_year", F.lit(1998)), "service")
    wanted = {"negative_duration", "high_fare", "null_pickup"}
    return spark.createDataFrame([(sorted(set(quality.active_issues(report)) & wanted),)], "issues array<string>")


_FEEDS = trips_sql("pu") + """, z AS (SELECT n_nationkey AS zone, n_name AS name, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey),
    u AS (SELECT pickup, dropoff, pu_zone, distance, fare, tip, fare + coalesce(tip, 0) AS total, 0 AS is_app, 'street' AS source FROM trips WHERE operator = 'A'
    UNION ALL SELECT pickup, dropoff, pu_zone, distance, fare, tip, fare + coalesce(tip, 0) + coalesce(passengers, 0), 1, 'app' FROM trips WHERE operator = 'R')"""


@query(_FEEDS + """ SELECT source, is_app, borough, count(*) AS n, round(1e-9 + sum(total), 2) AS total, round(1e-9 + avg(distance), 6) AS distance FROM u LEFT JOIN z ON pu_zone = zone
    WHERE dropoff > pickup AND distance > 0 AND distance < 40 AND fare >= 0 AND total BETWEEN 0 AND 60000 AND year(pickup) = 1995 GROUP BY ALL""")
def two_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds with names of their own on one schema, with zones attached and the quality gate of both."""
    c, every = F.col, trips(spark, sf, "pu")
    street = every.where("operator = 'A'").select(c("pickup").alias("street_pickup"), c("dropoff").alias("street_dropoff"), "pu_zone", c("distance").alias("trip_distance"), "fare", "tip")
    app = every.where("operator = 'R'").select("pickup", "dropoff", "pu_zone", c("distance").alias("trip_miles"), c("fare").alias("base_fare"), c("tip").alias("tips"), c("passengers").alias("tolls"))
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    one = street.select(c("street_pickup").alias("pickup"), c("street_dropoff").alias("dropoff"), "pu_zone", c("trip_distance").alias("distance"), "fare", "tip", (c("fare") + zero("tip")).alias("total"), F.lit(0).alias("is_app"), F.lit("street").alias("source"))
    two = app.select("pickup", "dropoff", "pu_zone", c("trip_miles").alias("distance"), c("base_fare").alias("fare"), c("tips").alias("tip"), (c("base_fare") + zero("tips") + zero("tolls")).alias("total"), F.lit(1).alias("is_app"), F.lit("app").alias("source"))
    rows = dates.year_between(one.unionByName(two), "pickup", 1995, 1995)
    rows = rows.where((c("dropoff") > c("pickup")) & (c("distance") > 0) & (c("distance") < 40) & (c("fare") >= 0) & c("total").between(0, 60000))
    zones = load(spark, sf, "nation").join(load(spark, sf, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("pu_zone"), c("r_name").alias("borough"))
    found = rows.join(zones, "pu_zone", "left").groupBy("source", "is_app", "borough")
    return found.agg(F.count("*").alias("n"), numbers.rounded(F.sum("total"), 2).alias("total"), numbers.rounded(F.avg("distance"), 6).alias("distance"))
