"""Tumbling-window statistics of streams, their sinks, and online k-means."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.functions.numbers import clean
from larkspur.operators.aggregates import window_stats
from larkspur.sources.shared import remove_path
from larkspur.sources.sinks import as_json


def replay(spark: SparkSession, path: str, schema: Any, files_per_trigger: int = 1, form: str = "parquet") -> DataFrame:
    """Files as a stream, in the order of their modification times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def event_time(rows: DataFrame, text: str, fallback: str | None = None, drop: bool = True) -> DataFrame:
    """rows with ts from a text or timestamp column, else from fallback; rows without any go."""
    found = F.col(text)
    parsed = F.try_to_timestamp(found) if dict(rows.dtypes)[text] == "string" else found.cast("timestamp")
    out = rows.withColumn("ts", F.coalesce(parsed, F.col(fallback)) if fallback else parsed)
    return out.where(F.col("ts").isNotNull()) if drop else out


def tumbling(rows: DataFrame, width: str, keys: Sequence[str], fields: Sequence[str], late: str = "0 seconds") -> DataFrame:
    """window_stats() of the events in ts. In a stream a window is emitted once, when the watermark has passed its end.

    Rows later than the watermark are dropped. The last windows of a stream stay open: the batch form has them.
    """
    cleaned = rows.withColumns({c: clean(F.col(c)) for c in fields})
    if rows.isStreaming:
        cleaned = cleaned.withWatermark("ts", late)
    return window_stats(cleaned, "ts", width, keys, fields)


def by_groups(rows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Each row once for each kind of group: group_type and group_value; rows whose value is null or '' leave that group."""
    pairs = F.array(*[F.struct(F.lit(name).alias("group_type"), F.col(column).cast("string").alias("group_value")) for name, column in groups.items()])
    out = rows.withColumn("_g", F.explode(pairs)).select("*", "_g.group_type", "_g.group_value").drop("_g")
    return out.where(F.col("group_value").isNotNull() & (F.col("group_value") != ""))


def to_files(stream: DataFrame, path: str, checkpoint: str, form: str = "json", every: str | None = None) -> StreamingQuery:
    """Appends what there is, exactly once, and ends; with every ("2 seconds") it goes on, a batch at that pace.

    The checkpoint is what the stream has read: the same one resumes there, a fresh one begins anew.
    """
    writer = stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def fan_out(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each batch, computed once, to all sinks with its number; a sink should overwrite by number."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Points that follow() settles at a time: at first, at most; and rounds in which it mends its guess before it takes fewer.
LEAST, MOST, ROUNDS = 16, 8192, 4


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (m x d) to each of k centres, which stay (k x 1 x d) or move (k x m x d)."""
    out = np.zeros((len(centres), len(points)))
    for j in range(points.shape[1]):
        gap = points[:, j] - centres[:, :, j]
        out += gap * gap
    return out


def _ways(points: np.ndarray, ids: np.ndarray, centres: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centres that each point meets (k x m x d) if the points go to ids in turn; centres and counts after them."""
    met, last = np.empty((len(centres), *points.shape)), np.empty_like(centres)
    for c in range(len(centres)):
        own = ids == c
        mine, first = points[own], int(counts[c]) + 1
        way = np.empty((len(mine) + 1, points.shape[1]))
        for j in range(points.shape[1]):
            x = float(centres[c, j])
            steps = [x]
            for n, v in enumerate(mine[:, j].tolist(), first):
                x += (v - x) / n
                steps.append(x)
            way[:, j] = steps
        met[c], last[c] = way[np.cumsum(own) - own], way[-1]
    return met, last, counts + np.bincount(ids, minlength=len(centres))


def follow(points: np.ndarray, centres: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and distance of each point, taken in turn, and the centres and counts after them.

    While there are fewer than k centres, points become some (distance 0). Afterwards the nearest centre (of equals the
    one with the lowest number) takes the point and moves by its share of the gap; distances are those before it moves.

    Points are settled a stretch at a time, with the result of one by one: clusters are guessed, centres moved by the
    guess, and each point's nearest centre found anew. Up to the first point whose cluster changes all are right, and so
    is that point's new one.
    """
    seeds = max(0, min(k - len(centres), len(points)))
    ids, distances = np.zeros(len(points), np.int64), np.zeros(len(points))
    ids[:seeds] = np.arange(len(centres), len(centres) + seeds)
    centres = np.concatenate([centres.reshape(-1, points.shape[1]), points[:seeds]]).astype(float)
    counts = np.concatenate([counts, np.ones(seeds, np.int64)]).astype(np.int64)
    at, most = seeds, LEAST if counts.sum() < 100 * MOST else MOST
    while at < len(points):
        some = points[at : at + most]
        found, rounds = _squares(some, centres[:, None]).argmin(axis=0), 0
        while True:
            guess, rounds = found, rounds + 1
            met, last, numbers = _ways(some, guess, centres, counts)
            squares = _squares(some, met)
            found = squares.argmin(axis=0)
            changed = np.flatnonzero(found != guess)
            if not len(changed) or rounds == ROUNDS:
                break
        right = int(changed[0]) + 1 if len(changed) else len(some)
        if len(changed):
            _, last, numbers = _ways(some[:right], found[:right], centres, counts)
        ids[at : at + right] = found[:right]
        distances[at : at + right] = np.sqrt(squares[found[:right], np.arange(right)])
        centres, counts, at = last, numbers, at + right
        most = min(2 * most, MOST) if rounds < 3 else max(most // 2, LEAST)
    return ids, distances, centres, counts


def _points(rows: DataFrame, features: dict[str, float], order: Sequence[str], keep: Sequence[str], group: str) -> DataFrame:
    """Groups side by side, each in order, with the scaled features as feature_0 and so on."""
    scaled = [(clean(F.col(c)) / s).alias(f"feature_{i}") for i, (c, s) in enumerate(features.items())]
    ready = rows.select(group, *keep, *[c for c in order if c not in keep and c != group], *scaled)
    return ready.repartition(group).sortWithinPartitions(group, *order)


class _Groups:
    """The centres of the group at hand, as batches of sorted rows come."""

    def __init__(self, k: int, n: int, group: str):
        self.k, self.n, self.group = k, n, group
        self._begin(None)

    def _begin(self, name: object) -> None:
        self.now, self.centres, self.counts = name, np.zeros((0, self.n)), np.zeros(0, np.int64)

    def stretches(self, batch: pa.RecordBatch) -> Iterator[tuple[object, bool, np.ndarray]]:
        """The batch's groups in turn: name, whether the group begins here, points."""
        names = batch[self.group].to_pylist()
        points = np.column_stack([batch[f"feature_{i}"].to_numpy(zero_copy_only=False) for i in range(self.n)]) if names else np.zeros((0, self.n))
        edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        for a, b in zip(edges, edges[1:]):
            yield names[a], names[a] != self.now, points[a:b]

    def take(self, name: object, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if name != self.now:
            self._begin(name)
        ids, distances, self.centres, self.counts = follow(points, self.centres, self.counts, self.k)
        return ids, distances


def online_kmeans(rows: DataFrame, k: int, features: dict[str, float], order: Sequence[str], keep: Sequence[str], group: str | None = None) -> DataFrame:
    """group, keep, cluster_id and cluster_distance of each row: each group has centres of its own, without group all rows
    share theirs.

    features maps columns to the numbers they are divided by. Points of a group are taken one by one in the given order,
    in bounded batches from a sorted shuffle. The algorithm is sequential: groups are what runs side by side, and a
    group, however large, is one task's; nearest_centres() and moved_centres() are the parallel form.
    """
    own = group or "_all"
    rows = rows if group else rows.withColumn(own, F.lit("all"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [own, *keep]) + ", cluster_id long, cluster_distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(k, len(features), own)
        for batch in batches:
            found = [groups.take(name, points) for name, _, points in groups.stretches(batch)]
            ids, distances = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in [own, *keep]], pa.array(ids.astype(np.int64)), pa.array(distances.astype(float))], names=[own, *keep, "cluster_id", "cluster_distance"])

    out = _points(rows, features, order, keep, own).mapInArrow(run, schema)
    return out if group else out.drop(own)


def kmeans_snapshots(rows: DataFrame, k: int, features: dict[str, float], order: Sequence[str], group: str, every: int = 1000) -> DataFrame:
    """group, event_count, cluster_id, count and the features' centres (unscaled, four places), after each `every` events and the last."""
    names, scales = list(features), np.array(list(features.values()), float)
    columns = [group, "event_count", "cluster_id", "count", *names]
    schema = f"`{group}` {rows.schema[group].dataType.simpleString()}, event_count long, cluster_id long, count long, " + ", ".join(f"`{c}` double" for c in names)
    types = [None, pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * len(names)]

    def shown(groups: _Groups) -> list[tuple]:
        return [(groups.now, int(groups.counts.sum()), i, int(groups.counts[i]), *(float(round(x, 4)) for x in c * scales)) for i, c in enumerate(groups.centres)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, kind = _Groups(k, len(names), group), None
        left = lambda: int(groups.counts.sum()) % every  # noqa: E731  events since the last snapshot

        def table(rows_: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows_)) if rows_ else [()] * len(columns)
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(cols, types)], names=columns)

        for batch in batches:
            out, kind = [], batch.schema.field(group).type
            for name, begins, points in groups.stretches(batch):
                if begins and left():
                    out += shown(groups)
                at = 0
                while at < len(points):
                    most = every - (0 if begins and at == 0 else left())
                    groups.take(name, points[at : at + most])
                    at += most
                    if not left():
                        out += shown(groups)
            yield table(out)
        if left():
            yield table(shown(groups))

    return _points(rows, features, order, [], group).mapInArrow(run, schema)


def nearest_centres(rows: DataFrame, centres: Sequence[Sequence[float]], features: dict[str, float]) -> DataFrame:
    """rows with cluster_id and cluster_distance by given centres (of scaled features), of equals the lowest number.

    Expressions alone: any number of rows and tasks, on a batch or a stream.
    """
    scaled = [clean(F.col(c)) / s for c, s in features.items()]
    far = [F.sqrt(sum(((x - float(v)) * (x - float(v)) for x, v in zip(scaled, centre)), F.lit(0.0))) for centre in centres]
    best = F.array_min(F.array(*[F.struct(d.alias("distance"), F.lit(i).cast("long").alias("id")) for i, d in enumerate(far)]))
    return rows.withColumn("_best", best).select(*rows.columns, F.col("_best.id").alias("cluster_id"), F.col("_best.distance").alias("cluster_distance"))


def moved_centres(assigned: DataFrame, features: dict[str, float], *keys: str) -> DataFrame:
    """keys, cluster_id, count and the mean of each feature (unscaled): one aggregation, the step of a batch of points."""
    return assigned.groupBy(*keys, "cluster_id").agg(F.count("*").alias("count"), *[F.avg(clean(F.col(c))).alias(c) for c in features])


def stream_kmeans(rows: DataFrame, k: int, features: dict[str, float], key: str, keep: Sequence[str] = (), group: str | None = None, every: int = 1000) -> DataFrame:
    """The same on a stream, with centres as state: kind, cluster_id, cluster_distance, key, keep, and event_count, count, centre.

    Rows of kind point are the events, one for one. Those of kind centre are snapshots, one a cluster, in the first
    batch after each `every` events; their centre is unscaled, four places. Points of a micro-batch are taken in the
    order of key; maxFilesPerTrigger bounds what a group holds of it at a time. kmeans_to_files() is the form for one
    model and batches of any size.
    """
    names, own, scales = list(features), group or "_all", np.array(list(features.values()), float)
    rows = rows if group else rows.withColumn(own, F.lit("all"))
    kept = [c for c in keep if c not in names]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [key, *kept]}
    columns = ["kind", own, "cluster_id", "cluster_distance", *kinds, *names, "event_count", "count", "centre"]
    schema = f"kind string, `{own}` string, cluster_id long, cluster_distance double, " + ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + "".join(f", `{c}` double" for c in names) + ", event_count long, count long, centre array<double>"

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        centres, counts = state.get if state.exists else ([], [])
        centres, counts = np.array(centres, float).reshape(-1, len(names)), np.array(counts, np.int64)
        events = pd.concat(list(batches)).sort_values(key)
        before = int(counts.sum()) // every
        ids, distances, centres, counts = follow(events[names].to_numpy(float) / scales, centres, counts, k)
        state.update((centres.tolist(), counts.tolist()))
        out = events.assign(kind="point", cluster_id=ids, cluster_distance=distances.round(6), event_count=None, count=None, centre=None)
        out[own] = str(name[0])
        yield out[columns]
        if int(counts.sum()) // every > before:
            shots = pd.DataFrame({"kind": "centre", own: str(name[0]), "cluster_id": range(len(counts)), "event_count": int(counts.sum()), "count": counts, "centre": (centres * scales).round(4).tolist()})
            yield shots.reindex(columns=columns)

    cleaned = rows.select(own, key, *kept, *[clean(F.col(n)).alias(n) for n in names])
    out = cleaned.groupBy(own).applyInPandasWithState(run, schema, "centres array<array<double>>, counts array<long>", "append", "NoTimeout")
    return out if group else out.drop(own)


#: Rows of a block, and blocks that a task takes at a time.
BLOCK, BLOCKS_AT_ONCE = 4096, 64
_MODEL = "block long, centres binary, counts binary"


def _blocks(rows: DataFrame, features: dict[str, float]) -> DataFrame:
    """block (numbers that ascend as rows do), points (scaled) and rows of each stretch of up to BLOCK sorted rows."""
    names, scales, size = list(features), np.array(list(features.values()), float), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
            points = np.column_stack([table[n].to_numpy() for n in names]) / scales
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([points.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "points", "rows"])

        held, left = [], size
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, left))
                at, left = at + held[-1].num_rows, left - held[-1].num_rows
                if not left:
                    yield block(held)
                    number, held, left = number + 1, [], size
        if held:
            yield block(held)

    return rows.mapInArrow(run, "block long, points binary, rows binary")


def _models(blocks: DataFrame, before: DataFrame, k: int, n: int) -> DataFrame:
    """The model (centres, counts) that each block meets, and under no block the one after all; before: the one at first.

    One task takes the blocks in turn, points alone.
    """

    def model(block: int | None, centres: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([centres.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["block", "centres", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, counts = np.zeros((0, n)), np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if row["points"] is None:
                    centres, counts = np.frombuffer(row["centres"]).reshape(-1, n), np.frombuffer(row["counts"], np.int64)
                    continue
                yield model(row["block"], centres, counts)
                _, _, centres, counts = follow(np.frombuffer(row["points"]).reshape(-1, n), centres, counts, k)
        yield model(None, centres, counts)

    first = before.select(F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("points"), "centres", "counts")
    rows = blocks.select("block", "points").unionByName(first, allowMissingColumns=True)
    return rows.repartition(1).sortWithinPartitions("block").mapInArrow(run, _MODEL)


def kmeans_to_files(rows: DataFrame, path: str, checkpoint: str, k: int, features: dict[str, float], key: str, keep: Sequence[str] = (), every: int = 1000) -> tuple[StreamingQuery, str]:
    """The rows of stream_kmeans() without group, written under path, and their schema; they are read from path/rows/*.

    The same model for micro-batches of any size. A batch is sorted by key in tasks and cut into blocks. One task takes
    the blocks' points in turn, nothing else, and notes the model that each block meets; all tasks then place the rows
    of their blocks from there. A batch overwrites what it left when it is repeated; the model after it is in
    path/models, so the same path and checkpoint resume.
    """
    names, scales, n = list(features), np.array(list(features.values()), float), len(features)
    kept = [c for c in keep if c not in names]
    cleaned = rows.select(key, *kept, *[clean(F.col(c)).alias(c) for c in names])
    kinds = {c: cleaned.schema[c].dataType.simpleString() for c in cleaned.columns}
    schema = "kind string, cluster_id long, cluster_distance double, " + ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", event_count long, count long, centre array<double>"
    columns = ["kind", "cluster_id", "cluster_distance", *kinds, "event_count", "count", "centre"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["points"]).reshape(-1, n)
                ids, distances, _, _ = follow(points, np.frombuffer(row["centres"]).reshape(-1, n), np.frombuffer(row["counts"], np.int64), k)
                table = pa.ipc.open_stream(row["rows"]).read_all().combine_chunks()
                size = len(table)
                none = [pa.nulls(size, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.float64()))]
                own = [c.combine_chunks() for c in (table[x] for x in kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(["point"] * size), pa.array(ids), pa.array(distances.round(6)), *own, *none], names=columns)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOCKS_AT_ONCE)}
        old = {c: spark.conf.get(c) for c in settings}
        at = {x: f"{path}/{x}/{number}" for x in ("blocks", "models", "rows")}
        try:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            ready = batch.repartitionByRange(key, *names).sortWithinPartitions(key, *names)
            _blocks(ready, features).write.mode("overwrite").option("compression", "zstd").parquet(at["blocks"])
            for c, value in settings.items():
                spark.conf.set(c, value)
            blocks = spark.read.schema("block long, points binary, rows binary").parquet(at["blocks"])
            first = spark.read.schema(_MODEL).parquet(f"{path}/models/{number - 1}").where("block IS NULL") if number else spark.createDataFrame([(None, b"", b"")], _MODEL)
            before = int(np.frombuffer(first.first()["counts"], np.int64).sum())
            _models(blocks, first, k, n).write.mode("overwrite").parquet(at["models"])
            models = spark.read.schema(_MODEL).parquet(at["models"])
            after = models.where("block IS NULL").first()
            centres, counts = np.frombuffer(after["centres"]).reshape(-1, n), np.frombuffer(after["counts"], np.int64)
            out = blocks.join(models, "block").mapInArrow(placed, schema)
            if (total := int(counts.sum())) // every > before // every:
                shots = [("centre", i, total, int(c), [float(x) for x in place]) for i, (c, place) in enumerate(zip(counts, (centres * scales).round(4)))]
                out = out.unionByName(spark.createDataFrame(shots, "kind string, cluster_id long, event_count long, count long, centre array<double>"), allowMissingColumns=True)
            out.write.mode("overwrite").parquet(at["rows"])
            remove_path(spark, at["blocks"])
        finally:
            for c, value in old.items():
                spark.conf.set(c, value)

    return cleaned.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), schema


def ordered_messages(rows: DataFrame, path: str, key: str, order: Sequence[str], files: int, last: str | None = None) -> None:
    """Rows as keyed JSON messages in `files` files whose names and times ascend in the rows' order, for replay(..., MESSAGES).

    A stream takes files by their times, which tasks that write side by side would mix up, so they are set afterwards;
    the file system must allow that, as local ones and HDFS do. With last, the name of the timestamp, one more message without key and far in the future ends the stream: when it
    has come, the watermark has passed all windows, so none stays open.
    """
    numbered = messages(rows, key, order)
    numbered.repartitionByRange(files, "place").sortWithinPartitions("place").write.mode("overwrite").json(path)
    in_order = sorted(_files(rows.sparkSession, path))
    if last:
        end = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("key"), F.to_json(F.struct(F.lit("2999-01-01T00:00:00").alias(last))).alias("value"))
        end.coalesce(1).write.mode("append").json(path)
    every = _files(rows.sparkSession, path)
    start = min(t for t, _ in every.values())
    for i, name in enumerate([*in_order, *sorted(set(every) - set(in_order))]):
        system, file = _hadoop(rows.sparkSession, f"{path}/{name}")
        system.setTimes(file, start + 1000 * i, -1)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Time and size of the data files of a folder, by name."""
    system, folder = _hadoop(spark, path)
    return {f.getPath().getName(): (f.getModificationTime(), f.getLen()) for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")}


#: The schema of replayed messages.
MESSAGES = "key string, value string"


def messages(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """place (what the rows are ordered by, as one value), key and value."""
    return rows.select(F.struct(*order).alias("place"), F.col(key).cast("string").alias("key"), as_json(rows).alias("value"))


def opened(stream: DataFrame, schema: str) -> DataFrame:
    """The messages' values as columns, with their key."""
    return stream.select(F.from_json("value", schema).alias("v"), "key").select("v.*", "key")
