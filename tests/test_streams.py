import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.streaming import windows

SF = "/root/testdata/sf0.001"
TS = dt.datetime
SCHEMA = "ts timestamp, kind string, value double, id long"


def _write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / name))


def _run(spark, tmp_path, files, width="30 seconds"):
    for i, rows in enumerate(files):
        _write(spark, tmp_path / "in", rows, f"{i:02}")
    stream = windows.replay(spark, str(tmp_path / "in" / "*"), SCHEMA)
    out = windows.tumbling(stream, width, ["kind"], ["value"])
    windows.to_files(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "parquet").awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def _at(s, kind="a", value=1.0, i=0):
    return (TS(2024, 1, 1) + dt.timedelta(seconds=s), kind, value, i)


def test_stream_gives_the_closed_windows_of_the_batch(spark, tmp_path):
    files = [[_at(0), _at(10, value=3.0)], [_at(30)], [_at(95, "b")], [_at(200)]]
    stream = {(r.kind, r.window_start.second, r.window_start.minute, r["count"], r.value_mean, r.value_std) for r in _run(spark, tmp_path, files).collect()}
    rows = spark.createDataFrame([r for f in files for r in f], SCHEMA)
    batch = {(r.kind, r.window_start.second, r.window_start.minute, r["count"], r.value_mean, r.value_std) for r in windows.tumbling(rows, "30 seconds", ["kind"], ["value"]).collect()}
    assert len(batch) == 4 and stream == {w for w in batch if not (w[1] == 0 and w[2] == 3)}


def test_late_rows_are_dropped(spark, tmp_path):
    files = [[_at(0)], [_at(100)], [_at(101)], [_at(5)], [_at(300)]]  # late against the watermark of the batch before
    found = {r.window_start.minute * 60 + r.window_start.second: r["count"] for r in _run(spark, tmp_path, files).collect()}
    assert found == {0: 1, 90: 2}


def test_numbers_without_value_count_as_zero(spark):
    rows = spark.createDataFrame([_at(0, value=None), _at(1, value=float("nan")), _at(2, value=3.0), _at(30, value=5.0)], SCHEMA)
    found = {r.window_start.second: r for r in windows.tumbling(rows, "30 seconds", ["kind"], ["value"]).collect()}
    assert (found[0]["count"], found[0].value_mean, found[0].value_min) == (3, 1.0, 0.0)
    assert (found[30]["count"], found[30].value_std, found[30].value_min, found[30].value_max) == (1, 0.0, 5.0, 5.0)


def test_event_time(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00", TS(2025, 1, 1)), ("x", TS(2025, 1, 1)), (None, None)], "t string, broker timestamp")
    assert windows.event_time(rows, "t").count() == 1
    assert sorted(r.ts.year for r in windows.event_time(rows, "t", "broker").collect()) == [2024, 2025]


def test_two_kinds_of_groups(spark):
    rows = spark.createDataFrame([_at(0, "a", 1.0, 7), _at(1, "", 1.0, 7), _at(2, None, 1.0, None)], SCHEMA)
    found = sorted((r.group_type, r.group_value) for r in windows.by_groups(rows, {"kind": "kind", "id": "id"}).collect())
    assert found == [("id", "7"), ("id", "7"), ("kind", "a")]


def test_fan_out(spark, tmp_path):
    _write(spark, tmp_path / "in", [_at(0), _at(1)], "0")
    stream = windows.replay(spark, str(tmp_path / "in" / "*"), SCHEMA)
    paths = [str(tmp_path / n) for n in "ab"]
    sinks = [lambda df, n, p=p: df.write.mode("overwrite").parquet(f"{p}/{n}") for p in paths]
    windows.fan_out(stream, str(tmp_path / "c"), *sinks).awaitTermination()
    assert [spark.read.parquet(f"{p}/*").count() for p in paths] == [2, 2]


POINTS = [0.0, 10.0, 5.0, 1.0, 9.0, 4.0]


def test_centres_by_hand():
    points = np.array(POINTS)[:, None]
    ids, distances, centres, counts = windows.follow(points, np.zeros((0, 1)), np.zeros(0, np.int64), 2)
    assert ids.tolist() == [0, 1, 0, 0, 1, 0] and distances[:3].tolist() == [0.0, 0.0, 5.0]  # a tie goes to the lowest id
    assert counts.tolist() == [4, 2] and centres.tolist() == [[2.5], [9.5]]
    for cut in range(len(POINTS)):  # in two calls, wherever the first ends
        a = windows.follow(points[:cut], np.zeros((0, 1)), np.zeros(0, np.int64), 2)
        b = windows.follow(points[cut:], a[2], a[3], 2)
        assert [*a[0], *b[0]] == ids.tolist() and b[2].tolist() == centres.tolist()


def test_kmeans_of_batch_and_stream_agree(spark, tmp_path):
    rows = [_at(i, k, p, i) for i, p in enumerate(POINTS) for k in "ab"]
    batch = windows.online_kmeans(spark.createDataFrame(rows, SCHEMA), 2, {"value": 1.0}, ["ts"], ["id"], "kind")
    want = sorted((r.kind, r.id, r.cluster_id, round(r.cluster_distance, 6)) for r in batch.collect())
    assert [w[2] for w in want if w[0] == "a"] == [0, 1, 0, 0, 1, 0]
    for i in range(0, len(rows), 4):
        _write(spark, tmp_path / "in", rows[i : i + 4], f"{i:02}")
    events = windows.replay(spark, str(tmp_path / "in" / "*"), SCHEMA).withColumnRenamed("kind", "type")
    stream = windows.stream_kmeans(events, 2, {"value": 1.0}, "id", ["ts"], "type", every=4)
    windows.to_files(stream, str(tmp_path / "out"), str(tmp_path / "c"), "parquet").awaitTermination()
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted((r.type, r.id, r.cluster_id, r.cluster_distance) for r in found.where("kind = 'point'").collect()) == want
    shots = sorted((r.type, r.event_count, r.cluster_id, r["count"], r.centre) for r in found.where("kind = 'centre'").collect())
    assert shots == [(k, 4, i, n, [c]) for k in "ab" for i, n, c in ((0, 3, 2.0), (1, 1, 10.0))]


def one_by_one(points, k):
    centres, counts, out = [], [], []
    for x in points:
        gaps = [[a - b for a, b in zip(x, c)] for c in centres]
        squares = [sum(g * g for g in gap) for gap in gaps]
        if len(centres) < k:
            out.append((len(centres), 0.0))
            centres.append(list(x))
            counts.append(1)
            continue
        at = squares.index(min(squares))
        out.append((at, squares[at] ** 0.5))
        counts[at] += 1
        centres[at] = [c + g / counts[at] for c, g in zip(centres[at], gaps[at])]
    return out, centres, counts


@pytest.mark.parametrize("size", [1, 3, 20_000])
def test_stretches_give_what_single_points_give(size, monkeypatch):
    """Also where centres swap points all the time (few values, many ties), and wherever a call ends."""
    monkeypatch.setattr(windows, "MOST", 4096)
    draw = np.random.default_rng(size)
    for points in (draw.random((3000, 2)), draw.integers(0, 4, (3000, 2)).astype(float), draw.exponential(size=(3000, 1)), np.repeat(draw.random((30, 3)), 100, axis=0)):
        want, centres, counts = one_by_one(points.tolist(), 5)
        found = [np.zeros(0), np.zeros(0), np.zeros((0, points.shape[1])), np.zeros(0, np.int64)]
        for at in range(0, len(points), size):
            some = windows.follow(points[at : at + size], found[2], found[3], 5)
            found = [np.concatenate([found[0], some[0]]), np.concatenate([found[1], some[1]]), *some[2:]]
        assert found[0].tolist() == [w[0] for w in want] and np.allclose(found[1], [w[1] for w in want], rtol=0, atol=1e-12)
        assert found[2].tolist() == centres and found[3].tolist() == counts


def test_rows_of_one_model_are_placed_by_many_tasks(spark, monkeypatch):
    """The query's rows are those of one model, event by event; no task has them all."""
    from larkspur.plans.streams import QUERIES

    monkeypatch.setattr(windows, "BLOCK", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's
    try:
        found = QUERIES["stream_kmeans"](spark, SF).withColumn("file", F.input_file_name()).orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()
    want = one_by_one([(e.value / 100.0, e.ts.hour / 24.0) for e in events], 5)[0]
    assert [(r.event_id, r.event_type, r.ts, r.user_id, r.value, r.cluster_id) for r in found] == [(e.event_id, e.event_type, e.ts, e.user_id, e.value, w[0]) for e, w in zip(events, want)]
    assert all(abs(r.cluster_distance - w[1]) < 1e-6 for r, w in zip(found, want))
    assert len({r.file for r in found}) > 1


def test_model_in_files_resumes(spark, tmp_path):
    """A second run with the same path and checkpoint goes on with the model; snapshots come as in stream_kmeans()."""

    def run():
        query, schema = windows.kmeans_to_files(windows.replay(spark, str(tmp_path / "in" / "*"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "c"), 2, {"value": 1.0}, "id", ["ts"], every=4)
        query.awaitTermination()
        return spark.read.schema(schema).parquet(str(tmp_path / "out" / "rows" / "*"))

    _write(spark, tmp_path / "in", [_at(i, "a", p, i) for i, p in enumerate(POINTS[:3])], "0")
    assert run().count() == 3
    _write(spark, tmp_path / "in", [_at(i, "a", p, i) for i, p in enumerate(POINTS) if i > 2], "1")
    found = run()
    assert [r.cluster_id for r in found.where("kind = 'point'").orderBy("id").collect()] == [0, 1, 0, 0, 1, 0]
    shots = sorted((r.event_count, r.cluster_id, r["count"], r.centre) for r in found.where("kind = 'centre'").collect())
    assert shots == [(6, 0, 4, [2.5]), (6, 1, 2, [9.5])]


def test_one_model_for_all(spark):
    rows = spark.createDataFrame([_at(i, "ab"[i % 2], p, i) for i, p in enumerate(POINTS)], SCHEMA)
    found = windows.online_kmeans(rows, 2, {"value": 1.0}, ["ts"], ["id"])
    assert [r.cluster_id for r in found.orderBy("id").collect()] == [0, 1, 0, 0, 1, 0] and found.columns == ["id", "cluster_id", "cluster_distance"]


def test_same_checkpoint_resumes(spark, tmp_path):
    """A second run reads what is new; a fresh checkpoint reads all."""
    _write(spark, tmp_path / "in", [_at(0), _at(1)], "0")
    run = lambda c, out: windows.to_files(windows.replay(spark, str(tmp_path / "in" / "*"), SCHEMA), str(tmp_path / out), str(tmp_path / c), "parquet").awaitTermination()
    count = lambda out: spark.read.parquet(str(tmp_path / out)).count()
    run("c", "out")
    _write(spark, tmp_path / "in", [_at(2)], "1")
    run("c", "out")
    run("fresh", "other")
    assert count("out") == 3 and count("other") == 3


def test_snapshots(spark):
    rows = spark.createDataFrame([_at(i, k, p, i) for i, p in enumerate(POINTS) for k in "ab"], SCHEMA)
    found = sorted(map(tuple, windows.kmeans_snapshots(rows, 2, {"value": 10.0}, ["ts"], "kind", every=4).collect()))
    one = [(4, 0, 3, 2.0), (4, 1, 1, 10.0), (6, 0, 4, 2.5), (6, 1, 2, 9.5)]
    assert found == [(k, *r) for k in "ab" for r in one]


def test_label(spark):
    from larkspur.functions.labels import trip_label

    assert spark.range(1).select(trip_label(F.lit(1.5), F.lit(9.6), F.lit(0.9))).first()[0] == "FHVHV (Uber/Lyft), short local trip (~1.5 mi, ~$10 fare)"
