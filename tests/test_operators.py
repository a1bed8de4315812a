import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import dates, geometry, numbers
from larkspur.operators import aggregates as agg
from larkspur.operators import demand, enrich, quality, spatial

TS = dt.datetime
NAN = float("nan")
RECORD = "pickup timestamp_ntz, dropoff timestamp_ntz, distance double, passengers double, fare double, file_year int"


def _checked(spark, *rows):
    base = [TS(2019, 5, 1), TS(2019, 5, 1, 1), 1.0, 1.0, 1.0, 2019]
    made = [tuple(r.get(k, b) for k, b in zip(("p", "d", "dist", "pax", "fare", "fy"), base)) for r in rows]
    return {r.year: r.asDict() for r in quality.quality_by_year(spark.createDataFrame(made, RECORD)).collect()}


@pytest.mark.parametrize(
    "row,found",
    [
        ({"p": TS(2016, 1, 1), "d": TS(1989, 1, 1), "fy": 2016}, {"placeholder_dropoff"}),
        ({"d": TS(2019, 5, 1)}, {"same_timestamps"}),
        ({"d": TS(2019, 4, 30)}, {"negative_duration"}),
        ({"d": TS(2019, 5, 2)}, set()),
        ({"d": TS(2019, 5, 2, 0, 0, 1)}, {"excessive_duration"}),
        ({"p": None}, {"null_pickup"}),
        ({"d": None}, {"null_dropoff"}),
        ({"p": TS(2017, 5, 1), "d": TS(2017, 5, 1, 1)}, {"invalid_year"}),
        ({"p": TS(2018, 5, 1), "d": TS(2018, 5, 1, 1)}, set()),
        ({"fare": NAN, "dist": NAN, "pax": NAN}, set()),
        ({"fare": 500.0}, set()),
        ({"fare": 500.01}, {"high_fare"}),
        ({"fare": -0.01}, {"negative_fare"}),
        ({"fare": None, "dist": None, "pax": None}, set()),
        ({"dist": 0.0, "pax": 0.0}, {"zero_distance", "zero_passengers"}),
        ({"dist": -1.0}, {"negative_distance"}),
    ],
)
def test_quality_checks(spark, row, found):
    (report,) = _checked(spark, row).values()
    assert {c for c in quality.ISSUES if report[c]} == found and report["total_rows"] == 1


def test_quality_of_null_pickup_is_in_the_files_year(spark):
    assert set(_checked(spark, {"p": None})) == {2019}


def test_rates_and_active(spark):
    rows = [(TS(2019, 1, 1), TS(2019, 1, 1, 1), float(i % 10 > 0), 1.0, 1.0, 2019) for i in range(100)]
    report = quality.quality_by_year(spark.createDataFrame(rows, RECORD))
    assert quality.with_rates(report).select("total_issues", "issue_rate", "severity").first() == (10, 10.0, "high")
    assert quality.active_issues(report) == ["zero_distance"]


def test_minutes_and_days(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-07 00:00:59' AS a, timestamp_ntz'2024-01-07 00:01:01' AS b")
    out = row.select(dates.minute_boundaries(F.col("a"), F.col("b")), dates.dow_sunday(F.col("a")), dates.dow_monday(F.col("a")), dates.hours_between(F.col("a"), F.col("b"))).first()
    assert tuple(out) == (1, 0, 6, 2 / 3600)


def test_year_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = dates.year_between(df, "o_orderdate", 1996, 1997)
    assert "GreaterThanOrEqual(o_orderdate" in out._jdf.queryExecution().toString()
    assert out.count() == df.where(F.year("o_orderdate").between(1996, 1997)).count()


def test_numbers(spark):
    rows = spark.createDataFrame([("1.5",), (None,), ("x",), ("NaN",), ("Infinity",)], "v string")
    assert [r[0] for r in rows.select(numbers.clean(F.col("v"))).collect()] == [1.5, 0, 0, 0, 0]
    fares = spark.createDataFrame([(v,) for v in (0.0, 4.99, 5.0, 204.99, 205.0)], "f double")
    assert [r[0] for r in fares.select(numbers.bucket(F.col("f"), 5)).collect()] == [0, 0, 5, 200, 205]
    assert spark.range(1).select(numbers.share(F.lit(1), F.lit(0)), numbers.share(F.lit(1), F.lit(4))).first() == (0.0, 25.0)
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (6.0, 2.0, 0.5, 0.0)], "r double").select(numbers.band(F.col("r"))).collect()] == ["high", "medium", "low", "none"]
    assert spark.range(1).select(numbers.shown_count(F.lit(1234)), numbers.shown_rate(F.lit(1.234))).first() == ("1,234", "1.23%")


def test_lookup_keys_must_be_unique(spark):
    rows = spark.createDataFrame([(1, 2), (3, None)], "pu int, do int")
    zones = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    out = enrich.look_up(enrich.look_up(rows, zones, {"pu": "id"}, "pu_"), zones, {"do": "id"}, "do_", fill="none")
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 2, "A", "B"), (3, None, None, "none")]
    with pytest.raises(ValueError):
        enrich.look_up(rows, zones.union(zones), {"pu": "id"})


def test_outer_chain_and_index(spark):
    a, b = spark.createDataFrame([("2019-01", 5), ("2019-02", 0)], "date string, x int"), spark.createDataFrame([("2019-03", 7)], "date string, y int")
    both = enrich.outer_chain([a, b], "date")
    assert sorted(map(tuple, both.collect())) == [("2019-01", 5, 0), ("2019-02", 0, 0), ("2019-03", 0, 7)]
    found = {r.date: (r.x_index, r.y_index) for r in agg.indexed(both, "date", "2019-01", ["x", "y"]).collect()}
    assert found == {"2019-01": (100.0, 0.0), "2019-02": (0.0, 0.0), "2019-03": (0.0, 700.0)}


def test_roll_ups_agree(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    cube = agg.temporal_cube(events, "ts", "event_type")
    direct = events.groupBy("event_type").agg(F.count("*").alias("trips"))
    assert sorted(map(tuple, agg.roll_up(cube, "event_type").collect())) == sorted(map(tuple, direct.collect()))


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    assert agg.error_metrics(rows, "y", "p").first() == (2, math.sqrt(0.5), 0.5, 0.5)
    assert agg.error_metrics(rows.withColumn("y", F.lit(1.0)), "y", "p").first().r2 is None
    assert agg.varying(rows.withColumn("c", F.lit(1)), ["y", "c"]) == ["y"]


SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
PARTS = "MULTIPOLYGON (((10 0, 12 0, 12 2, 10 2, 10 0)), ((20.5 -1, 22 -1, 22 2, 20.5 2, 20.5 -1)))"


def test_points_in_polygons(spark):
    zones = spark.createDataFrame([(1, SQUARE), (2, PARTS)], "zone int, wkt string").select("zone", geometry.wkt_rings(F.col("wkt")).alias("rings"))
    points = [(3.0, 3.0), (1.5, 1.5), (5.0, 1.0), (4.0, 2.0), (0.0, 0.0), (2.0, 1.5), (11.0, 1.0), (21.0, 0.0), (15.0, 1.0), (0.5, 3.9)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, x double, y double")
    for most in (10_000, 0):
        found = {r.i: r.zone for r in spatial.points_in_zones(rows, zones, "x", "y", "zone", cell=3.0, most_broadcast=most).collect()}
        assert found == {0: 1, 1: None, 2: None, 3: None, 4: None, 5: None, 6: 2, 7: 2, 8: None, 9: 1}
    assert {r.zone: r.n for r in spatial.zone_counts(rows, zones, "x", "y", "zone", "n").collect()} == {1: 2, 2: 2}
    c = zones.select(geometry.centroid(F.col("rings")[0]).alias("c")).first().c
    assert (c.x, c.y) == (2.0, 2.0)


def test_demand_flags(spark):
    rows = spark.createDataFrame([(2021, m, 1, h, d, 3, r, p) for m, h, d, r, p in [(6, 7, 5, 0.5, 9.0), (7, 9, 4, 0.51, 0.0), (1, 10, 0, None, 0.6), (1, 17, 6, None, None), (1, 19, 1, 0.0, 1.0), (1, 20, 1, 0.0, 0.0)]], "year int, month int, day int, hour int, dow int, trip_count long, rain double, wet double")
    out = demand.demand_features(rows, 2021, "rain", "wet").select("is_covid", "is_rush_hour", "is_weekend", "is_raining").collect()
    assert [tuple(r) for r in out] == [(1, 1, 1, 0), (0, 1, 0, 1), (1, 0, 0, 1), (1, 1, 1, 0), (1, 1, 0, 0), (1, 0, 0, 0)]


def test_models_learn(spark):
    rows = spark.range(400).selectExpr("cast(id % 20 as double) AS a", "cast(id % 7 as double) AS b", "cast(id as double) AS noise").withColumn("target", 0.1 * F.col("a") + 0.2 * F.col("b"))
    linear = demand.fit_linear(rows, ["a", "b", "none"])
    assert demand.evaluate(linear.transform(demand.filled(rows, ["a", "b", "none"]))).first().r2 > 0.99
    trees = demand.fit_boosted(rows, ["a", "b", "noise"], rounds=20)
    assert demand.evaluate(trees.transform(demand.filled(rows, ["a", "b", "noise"]))).first().r2 > 0.5
    assert {n for n, _ in demand.importances(trees, ["a", "b", "noise"])[:2]} == {"a", "b"}
    sgd = demand.fit_sgd(rows, ["a", "b"], epochs=30)
    assert sgd["losses"][-1] < 0.1 * sgd["losses"][0]
    assert demand.evaluate(demand.predict_sgd(rows, sgd, ["a", "b"])).first().r2 > 0.8


def test_registered_forecasts_have_all_rounds(spark, monkeypatch):
    """200 rounds for the model of all services, 150 for each service's and for the one without added features."""
    from larkspur.plans import enrichment

    asked, fit = [], demand.fit_boosted
    monkeypatch.setattr(enrichment, "_MADE", {})
    monkeypatch.setattr(demand, "fit_boosted", lambda rows, names, rounds: asked.append(rounds) or fit(rows, names, rounds=2))
    labels = {r.label for r in enrichment.model_comparison(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(asked) == [150] * 6 + [200] and {"unified", "separate", "base"} < labels and len(labels) == 8
    assert enrichment.gbt_forecast(spark, "/root/testdata/sf0.001").count() == 1 and len(asked) == 7
    names = [r.feature for r in enrichment.feature_importances(spark, "/root/testdata/sf0.001").collect()]
    assert set(names) == {*enrichment._INPUTS, "_code"}


def test_separate_models_are_joined_again(spark):
    """Metrics of all services' own models together are those of their predictions together."""
    rows = spark.range(300).selectExpr("cast(id % 20 as double) AS a", "CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS service", "cast(id % 20 + id % 3 as double) / 10 AS target")
    fit = lambda some, names, rounds: demand.fit_linear(some, names)
    found = {r.label: r for r in demand.compare(rows, rows, "service", ["x", "y", "none"], ["a"], [], fit).collect()}
    assert set(found) == {"unified", "base", "only x", "only y", "separate"} and found["separate"].n == 300 == found["unified"].n
    assert abs(found["separate"].mae * 300 - sum(found[f"only {s}"].mae * found[f"only {s}"].n for s in "xy")) < 1e-6
    assert found["separate"].rmse < found["unified"].rmse < found["base"].rmse


def test_exact_quantiles_in_ranges(spark):
    """Against a sort of each key's values; one key has most rows, nulls and ties among them."""
    import random

    import numpy as np

    from larkspur.operators.aggregates import exact_quantiles

    draw = random.Random(3)
    rows = [("hot" if i % 10 else f"k{i % 50}", None if i % 17 == 0 else float(draw.randrange(200))) for i in range(3000)] + [("one", 4.0), ("none", None)]
    found = {r.k: (r.a, r.b) for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"a": 0.25, "b": 0.9}).collect()}
    for k in {k for k, _ in rows} - {"none"}:
        values = [v for x, v in rows if x == k and v is not None]
        assert np.allclose(found[k], np.quantile(values, [0.25, 0.9]))
    assert "none" not in found


def test_wide_lookups_are_not_broadcast(spark, monkeypatch):
    from larkspur.operators import enrich

    side = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k int, v string")
    plan = lambda: enrich.look_up(spark.range(9).selectExpr("cast(id as int) AS k2"), side, {"k2": "k"})._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(enrich, "MOST_BYTES", 1000)
    assert "broadcast" not in plan()


def test_text_and_time_expressions(spark):
    from larkspur.functions import dates, texts

    row = spark.createDataFrame([("a b/c" * 20, dt.datetime(2024, 3, 1, 7, 5, 9, 123456))], "t string, ts timestamp_ntz").select(
        texts.label(F.col("t")).alias("l"), texts.year_month(F.col("ts")).alias("m"), texts.padded(F.lit(7), 3).alias("p"), texts.found(F.col("t"), "(z)").alias("f"),
        dates.iso(F.col("ts")).alias("i"), dates.epoch_ms(F.col("ts")).alias("e"), dates.now_iso().alias("n")).first()
    assert len(row.l) == 60 and row.l.startswith("a_b_ca") and (row.m, row.p, row.f, row.i, row.e) == ("2024-03", "007", "", "2024-03-01T07:05:09", 1709276709123) and len(row.n) == 19


