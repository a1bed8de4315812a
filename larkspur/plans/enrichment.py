"""Lookup joins, spatial joins, demand features and scalar conversions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, geometry, numbers
from larkspur.functions.numbers import rounded
from larkspur.operators import aggregates as agg
from larkspur.operators import demand, enrich, spatial
from larkspur.plans.base import DO, PU, registrar, trips, trips_sql
from larkspur.plans.trips import SERVICES
from larkspur.sources.shared import written
from larkspur.sources.sinks import as_json
from larkspur.sources.tables import load

QUERIES, ORACLE_SQL, query = registrar()


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name"), F.col("r_name").alias("borough"))


_ZONES = "zones AS (SELECT n_nationkey AS zone, n_name AS name, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(trips_sql(PU, DO) + f""", {_ZONES} SELECT p.borough AS PU_borough, d.borough AS DO_borough, count(*) AS trips, round(1e-9 + sum(fare + coalesce(tip, 0)), 2) AS total
    FROM trips LEFT JOIN zones p ON pu_zone = p.zone LEFT JOIN zones d ON do_zone = d.zone WHERE dropoff > pickup AND distance > 0 AND distance < 200 AND fare >= 0 GROUP BY 1, 2""")
def role_double_join(spark: SparkSession, sf: str) -> DataFrame:
    """One zone table in two roles; the filter needs no zone, so it runs below both joins."""
    zones, c = _zones(spark, sf), F.col
    rows = enrich.look_up(trips(spark, sf, PU, DO), zones, {"pu_zone": "zone"}, "PU_")
    rows = enrich.look_up(rows, zones, {"do_zone": "zone"}, "DO_")
    rows = rows.where((c("dropoff") > c("pickup")) & (c("distance") > 0) & (c("distance") < 200) & (c("fare") >= 0))
    return rows.groupBy("PU_borough", "DO_borough").agg(F.count("*").alias("trips"), rounded(F.sum(c("fare") + F.coalesce(c("tip"), F.lit(0.0))), 2).alias("total"))


@query("WITH w AS (SELECT date_trunc('hour', ts) AS time, avg(value) AS temperature FROM events GROUP BY 1) SELECT event_id, event_type, round(1e-9 + temperature, 6) AS temperature FROM events LEFT JOIN w ON date_trunc('hour', ts) = time")
def hourly_weather_enrich(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("hour", dates.hour_floor(F.col("ts")))
    weather = events.groupBy(F.col("hour").alias("time")).agg(F.avg("value").alias("temperature"))
    return enrich.look_up(events, weather, {"hour": "time"}, check=False).select("event_id", "event_type", rounded(F.col("temperature"), 6).alias("temperature"))


@query("""WITH e AS (SELECT user_id, ts::DATE AS day, count(*) AS events FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT event_id, coalesce(events, 0)::BIGINT AS event_count FROM events v LEFT JOIN e ON v.user_id = e.user_id AND v.ts::DATE = e.day""")
def composite_event_join(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    counts = events.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count("*").alias("event_count"))
    return enrich.look_up(events, counts, {"user_id": "user_id", "day": "day"}, fill=0, check=False).select("event_id", "event_count")


@query("SELECT event_id, c_nationkey AS zone, ts::DATE AS date FROM events JOIN customer ON user_id = c_custkey")
def event_location_inner(spark: SparkSession, sf: str) -> DataFrame:
    places = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("zone"))
    return load(spark, sf, "events").join(places, "user_id").select("event_id", "zone", F.to_date("ts").alias("date"))


@query(f"""WITH {_ZONES}, s AS (SELECT s_nationkey AS zone, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS zone, count(*) AS n FROM customer GROUP BY 1),
    o AS (SELECT c_nationkey AS zone, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT z.zone, name, borough, coalesce(s.n, 0)::INTEGER AS school_count, coalesce(c.n, 0)::INTEGER AS business_count, coalesce(o.n, 0)::INTEGER AS attraction_count
    FROM zones z LEFT JOIN s USING (zone) LEFT JOIN c USING (zone) LEFT JOIN o USING (zone)""")
def zone_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    customer = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("zone"))
    parts = {
        "school_count": load(spark, sf, "supplier").select(F.col("s_nationkey").alias("zone")),
        "business_count": customer,
        "attraction_count": load(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")),
    }
    out = _zones(spark, sf)
    for name, rows in parts.items():
        out = out.join(rows.groupBy("zone").agg(F.count("*").cast("int").alias(name)), "zone", "left")
    return out.na.fill(0, list(parts))


@query(trips_sql(PU) + """ SELECT service, pu_zone, year(pickup)::INTEGER AS year, month(pickup)::INTEGER AS month, day(pickup)::INTEGER AS day, hour(pickup)::INTEGER AS hour, (isodow(pickup) - 1)::INTEGER AS dow,
    count(*) AS trip_count FROM trips WHERE pu_zone IS NOT NULL AND pickup IS NOT NULL GROUP BY ALL""")
def zone_hour_demand(spark: SparkSession, sf: str) -> DataFrame:
    return demand.zone_hour_demand(trips(spark, sf, PU), "pu_zone", "pickup", (), "service")


_DEMAND = """WITH d AS (SELECT user_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, isodow(ts) - 1 AS dow, count(*) AS trip_count, max(value / 100) AS rain FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos, (year - 2021) / 2.0::DOUBLE AS year_norm,
    (dow >= 5)::INTEGER AS is_weekend, (hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19)::INTEGER AS is_rush_hour, ((year = 2020 AND month >= 3) OR (year = 2021 AND month <= 6))::INTEGER AS is_covid, (rain > 0.5)::INTEGER AS is_raining, ln(1 + trip_count) AS target FROM d)"""


def _demand(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("rain", F.col("value") / 100)
    return demand.demand_features(demand.zone_hour_demand(events, "user_id", "ts", ("rain",)), 2021, "rain")


@query(_DEMAND + " SELECT user_id, day::INTEGER AS day, hour::INTEGER AS hour, trip_count, round(1e-9 + hour_sin, 6) AS hour_sin, round(1e-9 + hour_cos, 6) AS hour_cos, round(1e-9 + dow_sin, 6) AS dow_sin, round(1e-9 + dow_cos, 6) AS dow_cos, round(1e-9 + year_norm, 6) AS year_norm, is_weekend, is_rush_hour, is_covid, is_raining, round(1e-9 + target, 6) AS target FROM f")
def demand_features(spark: SparkSession, sf: str) -> DataFrame:
    shown = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "year_norm", "target")
    flags = ("is_weekend", "is_rush_hour", "is_covid", "is_raining")
    return _demand(spark, sf).select("user_id", "day", "hour", "trip_count", *[rounded(F.col(c), 6).alias(c) for c in shown], *flags)


@query(_DEMAND + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, min({c})::DOUBLE AS value FROM f HAVING count(DISTINCT {c}) <= 1" for c in ("year_norm", "is_weekend", "is_covid", "is_raining", "hour_sin")))
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Features that don't vary, with their one value: their smallest isn't below their largest."""
    names = ("year_norm", "is_weekend", "is_covid", "is_raining", "hour_sin")
    ends = _demand(spark, sf).agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in names])
    return ends.unpivot([], list(names), "feature", "ends").where("NOT ends.low < ends.high").select("feature", F.col("ends.low").alias("value"))


@query(trips_sql() + ", p AS (SELECT fare AS y, avg(fare) OVER (PARTITION BY operator) AS yhat FROM trips) SELECT count(*) AS n, round(1e-9 + sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round(1e-9 + avg(abs(y - yhat)), 4) AS mae, round(1e-9 + 1 - avg((y - yhat) ** 2) / var_pop(y), 6) AS r2 FROM p")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each operator's mean fare: the means are a few rows, which adaptive execution sees and broadcasts."""
    rows = trips(spark, sf).select("operator", "fare")
    means = rows.groupBy("operator").agg(F.avg("fare").alias("guess"))
    found = agg.error_metrics(rows.join(means, "operator"), "fare", "guess")
    return found.select("n", rounded(F.col("rmse"), 4).alias("rmse"), rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("r2"), 6).alias("r2"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, (CAST(props->>'k' AS BIGINT) * 2)::DOUBLE AS doubled FROM events")
def canonical_cast(spark: SparkSession, sf: str) -> DataFrame:
    """A number out of JSON text; what isn't one is null, row by row."""
    k = F.get_json_object("props", "$.k")
    return load(spark, sf, "events").select("event_id", k.try_cast("long").alias("k"), (k.try_cast("long") * 2).cast("double").alias("doubled"))


@query("SELECT event_id, user_id, value, event_type FROM events")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    return rows.select(F.from_json(as_json(rows), rows.schema).alias("r")).select("r.*")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def explode_structs(spark: SparkSession, sf: str) -> DataFrame:
    """Counts gathered as a list of structs for each user, and unfolded again; a user has one struct a type."""
    counted = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    lists = counted.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "n")).alias("types"))
    return lists.select("user_id", F.inline(F.array_sort("types")))


@query("SELECT n_nationkey AS zone, n_name AS name, n_regionkey AS region FROM nation")
def parallel_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays of a small table, zipped back to rows."""
    from larkspur.sources.tables import parallel_arrays as unzip

    nation = load(spark, sf, "nation")
    packed = nation.groupBy("n_regionkey").agg(F.struct(*[F.collect_list(c).alias(c) for c in ("n_nationkey", "n_name")], F.collect_list(F.col("n_regionkey")).alias("n_region")).alias("hourly"))
    return unzip(packed, "hourly", {"n_nationkey": "zone", "n_name": "name", "n_region": "region"})


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 3 AS x, embedding[2]::DOUBLE * 3 AS y FROM embeddings),
    z AS (SELECT i * 3 + j AS zone, (i - 1.5)::DOUBLE / 2 AS x0, (j - 1.5)::DOUBLE / 2 AS y0 FROM range(3) a(i), range(3) b(j))
    SELECT z.zone::INTEGER AS zone, count(vec_id) AS points FROM z LEFT JOIN p ON x > x0 AND x < x0 + 0.5 AND y > y0 AND y < y0 + 0.5 GROUP BY 1""")
def spatial_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Points strictly within squares given as WKT polygons."""
    points = load(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 3).alias("x"), (F.col("embedding")[1].cast("double") * 3).alias("y"))
    corner = lambda i: (i - 1.5) / 2
    rows = [(i * 3 + j, f"POLYGON (({corner(i)} {corner(j)}, {corner(i) + 0.5} {corner(j)}, {corner(i) + 0.5} {corner(j) + 0.5}, {corner(i)} {corner(j) + 0.5}, {corner(i)} {corner(j)}))") for i in range(3) for j in range(3)]
    zones = spark.createDataFrame(rows, "zone int, wkt string").select("zone", geometry.wkt_rings(F.col("wkt")).alias("rings"))
    return spatial.zone_counts(points, zones, "x", "y", "zone", "points", cell=0.5)


@query("SELECT event_id, CASE WHEN value IS NULL OR value = 0 THEN '—' ELSE printf('%.2f%%', value) END AS shown, CASE WHEN value > 5 THEN 'high' WHEN value > 1 THEN 'medium' WHEN value > 0 THEN 'low' ELSE 'none' END AS severity FROM events")
def shown_rates(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", numbers.shown_rate(F.col("value")).alias("shown"), numbers.band(F.col("value")).alias("severity"))


@query()
def bernoulli_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five percent of the events, seeded; the sample is the feature."""
    return load(spark, sf, "events").sample(False, 0.05, 7).select("event_id", "ts", "value")


#: Tables and models that several queries of a session share, by application and folder.
_MADE: dict[tuple, object] = {}


def _made(spark: SparkSession, sf: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Demand by service, zone and hour before 1998 and in 1998, with weather and zone features, as written tables."""

    def make() -> tuple[DataFrame, DataFrame]:
        rows = demand.zone_hour_demand(trips(spark, sf, PU), "pu_zone", "pickup", (), "service")
        events = load(spark, sf, "events")
        weather = events.groupBy(F.month("ts").alias("month"), F.dayofmonth("ts").alias("day")).agg((F.avg("value") / 100).alias("rain"))
        places = {"zone_schools": load(spark, sf, "supplier").select(F.col("s_nationkey").alias("pu_zone")), "zone_businesses": load(spark, sf, "customer").select(F.col("c_nationkey").alias("pu_zone"))}
        rows = rows.join(weather, ["month", "day"], "left")
        for name, some in places.items():
            rows = rows.join(some.groupBy("pu_zone").agg(F.count("*").alias(name)), "pu_zone", "left")
        rows = demand.demand_features(rows, 1995, "rain")
        return written(rows.where("year < 1998")), written(rows.where("year = 1998"))

    return _made(spark, sf, "halves", make)


_INPUTS = (*demand.BASE_FEATURES, "is_raining", "zone_schools", "zone_businesses")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    """The boosted models side by side, fitted once a session: 200 rounds for the one of all, 150 for the others."""

    def make() -> DataFrame:
        train, test = _halves(spark, sf)

        def fit(rows: DataFrame, names: Sequence[str], rounds: int):
            model = demand.fit_boosted(rows, names, rounds=rounds)
            if rounds == 200:
                _MADE[spark.sparkContext.applicationId, sf, "unified"] = demand.importances(model, names)
            return model

        found = demand.compare(train, test, "service", SERVICES, _INPUTS, demand.BASE_FEATURES, fit).collect()  # a row a model
        return spark.createDataFrame(found, "label string, n long, rmse double, mae double, r2 double")

    return _made(spark, sf, "compared", make)


@query()
def linear_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    model = demand.fit_linear(train, _INPUTS)
    return demand.evaluate(model.transform(demand.filled(test, _INPUTS)))


@query()
def gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The one boosted model of all services, 200 rounds."""
    return _compared(spark, sf).where("label = 'unified'").drop("label")


@query()
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """One model for all services, one for each and these together, and one without weather and zone features."""
    return _compared(spark, sf)


@query()
def feature_importances(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of the one model of all services by importance; their names are kept."""
    _compared(spark, sf)
    return spark.createDataFrame(_made(spark, sf, "unified", list), "feature string, importance double")


@query()
def sgd_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    model = demand.fit_sgd(train, _INPUTS)
    return demand.evaluate(demand.predict_sgd(test, model, _INPUTS))


@query()
def sgd_convergence(spark: SparkSession, sf: str) -> DataFrame:
    """Training error, rate and error on the test year after each epoch."""
    train, test = _halves(spark, sf)
    model = demand.fit_sgd(train, _INPUTS, test=test)
    rows = [(i + 1, *r) for i, r in enumerate(zip(model["losses"], model["rates"], model["tested"]))]
    return spark.createDataFrame(rows, "epoch int, loss double, rate double, test_rmse double")


_TREND = trips_sql() + ", m AS (SELECT service, (year(pickup) - 1992) * 12 + month(pickup) AS x, count(*)::DOUBLE AS y FROM trips GROUP BY 1, 2)"


@query(_TREND + " SELECT service, round(1e-9 + regr_slope(y, x), 6) AS slope, round(1e-9 + regr_intercept(y, x), 4) AS intercept, round(1e-9 + regr_r2(y, x), 6) AS r2, regr_count(y, x)::BIGINT AS n FROM m GROUP BY 1")
def linear_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares of monthly trips on the month, by service: closed form, in one aggregation."""
    month = (F.year("pickup") - 1992) * 12 + F.month("pickup")
    rows = trips(spark, sf).groupBy("service", month.alias("x")).agg(F.count("*").cast("double").alias("y"))
    found = rows.groupBy("service").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n"))
    return found.withColumns({c: rounded(F.col(c), p) for c, p in (("slope", 6), ("intercept", 4), ("r2", 6))})


@query(_DEMAND + " SELECT count(*) AS rows, sum(coalesce(is_raining, 0))::BIGINT AS raining, 0.0::DOUBLE AS missing, round(1e-9 + sum(hour_sin), 4) AS hour_sin FROM f")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Features as doubles without nulls; one that a table lacks is 0."""
    rows = demand.filled(_demand(spark, sf), ("is_raining", "hour_sin", "missing"))
    return rows.agg(F.count("*").alias("rows"), F.sum("is_raining").cast("long").alias("raining"), F.sum("missing").alias("missing"), rounded(F.sum("hour_sin"), 4).alias("hour_sin"))
