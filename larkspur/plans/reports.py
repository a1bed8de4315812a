"""Tumbling windows as a batch, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.numbers import rounded, weighted
from larkspur.operators import aggregates as agg
from larkspur.plans.base import registrar
from larkspur.sources.tables import load
from larkspur.streaming import windows

QUERIES, ORACLE_SQL, query = registrar()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.event_time(load(spark, sf, "events").drop("props"), "ts")


def _sql(seconds: int, key: str = "event_type", where: str = "TRUE") -> str:
    start = f"to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})"
    return f"""SELECT {key}, {start} AS window_start, to_timestamp((floor(epoch(ts) / {seconds}) + 1) * {seconds}) AS window_end, count(*) AS count, round(1e-9 + avg(value), 4) AS value_mean,
        round(1e-9 + stddev_pop(value), 4) AS value_std, round(1e-9 + min(value), 4) AS value_min, round(1e-9 + max(value), 4) AS value_max FROM events WHERE {where} GROUP BY ALL"""


@query(_sql(30))
def tumbling_stats_30s(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf), "30 seconds", ["event_type"], ["value"])


@query(_sql(3600))
def tumbling_stats_1h(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf), "1 hour", ["event_type"], ["value"])


@query("WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) " + _sql(86400, "user_id", "user_id IN (SELECT user_id FROM top)"))
def top_group_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the ten busiest users."""
    events = _events(spark, sf)
    busiest = agg.top(events.groupBy("user_id").agg(F.count("*").alias("n")), "n", 10, "user_id")
    return windows.tumbling(events.join(F.broadcast(busiest.select("user_id")), "user_id", "left_semi"), "1 day", ["user_id"], ["value"])


@query(f"""SELECT 'type' AS group_type, event_type AS group_value, * EXCLUDE event_type FROM ({_sql(86400)}) UNION ALL SELECT 'user', user_id::VARCHAR, * EXCLUDE user_id FROM ({_sql(86400, 'user_id')})""")
def dual_group_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by type and by user from one pass."""
    both = windows.by_groups(_events(spark, sf), {"type": "event_type", "user": "user_id"})
    return windows.tumbling(both, "1 day", ["group_type", "group_value"], ["value"])


_HOURS = f"WITH w AS ({_sql(3600)})"


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf), "1 hour", ["event_type"], ["value"])


@query(_HOURS + " SELECT event_type, sum(count)::BIGINT AS total_events, round(1e-9 + sum(value_mean * count) / sum(count), 6) AS value_mean, round(1e-9 + avg(value_std), 6) AS value_mean_of_stds FROM w GROUP BY 1")
def window_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = agg.window_summary(_hours(spark, sf), ["event_type"], ["value"])
    return found.withColumns({c: rounded(F.col(c), 6) for c in ("value_mean", "value_mean_of_stds")})


@query(_HOURS + " SELECT event_type, strftime(window_start, '%Y-%m-%d') AS day, sum(count)::BIGINT AS events, round(1e-9 + sum(value_mean * count) / sum(count), 6) AS value_mean FROM w GROUP BY 1, 2")
def daily_weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    days = _hours(spark, sf).groupBy("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"))
    return days.agg(F.sum("count").alias("events"), rounded(weighted(F.col("value_mean"), F.col("count")), 6).alias("value_mean"))


_DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


@query(_HOURS + ", h AS (SELECT hour(window_start)::INTEGER AS hod, dayofweek(window_start) AS dow, sum(value_mean * count) / sum(count) AS mean FROM w GROUP BY 1, 2) SELECT r.range::INTEGER AS hod, " + ", ".join(
    f"coalesce(round(1e-9 + max(mean) FILTER (dow = {i}), 6), 0) AS {d}" for i, d in enumerate(_DAYS)) + " FROM range(24) r LEFT JOIN h ON h.hod = r.range GROUP BY 1")
def dow_hour_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Hours down, days across, gaps filled."""
    cells = _hours(spark, sf).groupBy(F.hour("window_start").alias("hod"), (F.dayofweek("window_start") - 1).alias("dow")).agg(weighted(F.col("value_mean"), F.col("count")).alias("mean"))
    wide = cells.groupBy("hod").pivot("dow", list(range(7))).agg(rounded(F.max("mean"), 6)).withColumnsRenamed({str(i): d for i, d in enumerate(_DAYS)})
    return agg.gap_filled(wide, "hod", 0, 23)


@query(_HOURS + ", d AS (SELECT strftime(window_start, '%Y-%m-%d') AS day, sum(count) AS n FROM w GROUP BY 1 ORDER BY n DESC, day LIMIT 1) SELECT event_type, window_start, count, value_mean FROM w WHERE strftime(window_start, '%Y-%m-%d') = (SELECT day FROM d)")
def busiest_day_zoom(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of the day with most events; the day is one row."""
    hours = _hours(spark, sf).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    day = agg.top(hours.groupBy("day").agg(F.sum("count").alias("n")), "n", 1, "day").select("day")
    return hours.join(F.broadcast(day), "day", "left_semi").select("event_type", "window_start", "count", "value_mean")


@query(f"WITH a AS ({_sql(30)}), b AS ({_sql(3600)}) " + " UNION ALL ".join(f"SELECT '{n}' AS implementation, count(*) AS records, sum(count)::BIGINT AS events, round(1e-9 + sum(value_mean * count) / sum(count), 3) AS value_mean FROM {t}" for n, t in (("fine", "a"), ("coarse", "b"))))
def implementation_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Records, events and weighted mean of two ways to window the same events."""
    parts = [("fine", tumbling_stats_30s(spark, sf)), ("coarse", tumbling_stats_1h(spark, sf))]
    totals = [rows.agg(F.count("*").alias("records"), F.sum("count").alias("events"), rounded(weighted(F.col("value_mean"), F.col("count")), 3).alias("value_mean")).select(F.lit(n).alias("implementation"), "*") for n, rows in parts]
    return totals[0].unionByName(totals[1])


@query(_HOURS + ", l AS (SELECT event_type, window_start, unnest(['value_mean', 'value_std', 'value_min', 'value_max']) AS field, unnest([value_mean, value_std, value_min, value_max]) AS number FROM w) SELECT * FROM l")
def long_reshape(spark: SparkSession, sf: str) -> DataFrame:
    return _hours(spark, sf).unpivot(["event_type", "window_start"], ["value_mean", "value_std", "value_min", "value_max"], "field", "number")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each type, ties by the larger id, in one aggregation."""
    return load(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_RANKS = ", ".join(f"round(1e-9 + quantile_cont(value, {p}), 6) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))


@query(f"SELECT event_type, count(*) AS n, round(1e-9 + avg(value), 6) AS mean, round(1e-9 + stddev_samp(value), 6) AS std, min(value) AS min, {_RANKS}, max(value) AS max, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def describe_values(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles are exact, yet no task holds a type's values: ranks come from counts of the ranges that values are sorted in."""
    events = load(spark, sf, "events").select("event_type", "value", "user_id")
    plain = events.groupBy("event_type").agg(
        F.count("*").alias("n"), rounded(F.avg("value"), 6).alias("mean"), rounded(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_distinct("user_id").alias("users"))
    found = agg.exact_quantiles(events, "event_type", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(found, "event_type").withColumns({q: rounded(F.col(q), 6) for q in ("q25", "q50", "q75")})


@query("""WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""")
def top_groups_filter(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    most = agg.top(events.groupBy("user_id").agg(F.count("*").alias("n")), "n", 5, "user_id").select("user_id")
    return events.join(F.broadcast(most), "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
