"""Counts over time, weighted re-aggregation, shares, indices, top-k and window summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.dates import dow_sunday, month_start
from larkspur.functions.numbers import rounded, share, weighted
from larkspur.sources.shared import written


def temporal_cube(rows: DataFrame, ts: str, *keys: str) -> DataFrame:
    """trips by keys, year, month, hour and day of the week (Sunday 0)."""
    t = F.col(ts)
    return rows.groupBy(*keys, F.year(t).alias("year"), F.month(t).alias("month"), F.hour(t).alias("hour"), dow_sunday(t).alias("dow")).agg(F.count("*").alias("trips"))


def roll_up(cube: DataFrame, *keys: str) -> DataFrame:
    """trips of a cube by some of its keys."""
    return cube.groupBy(*keys).agg(F.sum("trips").alias("trips"))


def monthly(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys, month_start(F.col("year"), F.col("month")).alias("date")).agg(F.sum("trips").alias("trips"))


def weighted_means(parts: DataFrame, keys: Sequence[str], weight: str, means: Sequence[str]) -> DataFrame:
    """Means of means, weighted by the counts behind them, and the sum of the weights."""
    return parts.groupBy(*keys).agg(*[weighted(F.col(m), F.col(weight)).alias(m) for m in means], F.sum(weight).alias(weight))


def top(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n largest by `by`; ties by the smaller `tie`. No full sort: each partition keeps n."""
    return rows.orderBy(F.desc(by), F.asc(tie)).limit(n)


def shares(rows: DataFrame, parts: Sequence[str], whole: str) -> DataFrame:
    """A column part_share for each part: percent of whole, 0 where that is 0."""
    return rows.withColumns({f"{p}_share": share(F.col(p), F.col(whole)) for p in parts})


def indexed(rows: DataFrame, date: str, base: str, columns: Sequence[str]) -> DataFrame:
    """Each column as a percentage of its value at the base date, which counts as 1 at least."""
    at = rows.where(F.col(date) == F.lit(base).cast(dict(rows.dtypes)[date])).agg(*[F.greatest(F.max(c).cast("double"), F.lit(1.0)).alias(f"_{c}") for c in columns])
    return rows.join(F.broadcast(at)).select(date, *[(F.col(c).cast("double") / F.col(f"_{c}") * 100).alias(f"{c}_index") for c in columns])  # one row


def share_within(value: str, *group: str) -> Column:
    """Percent of the group's total."""
    return F.col(value).cast("double") / F.sum(value).over(Window.partitionBy(*group)) * 100


def window_stats(rows: DataFrame, ts: str, width: str, keys: Sequence[str], fields: Sequence[str], places: int = 4) -> DataFrame:
    """count, and mean, population standard deviation, min and max of each field, by tumbling window and keys.

    Fields are numbers without nulls (see numbers.clean). The same expression serves a batch and a stream.
    """
    stats = [f(c).alias(f"{c}_{n}") for c in fields for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    out = rows.groupBy(F.window(ts, width).alias("_w"), *keys).agg(F.count("*").alias("count"), *stats)
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "count", *[rounded(F.col(f"{c}_{n}"), places).alias(f"{c}_{n}") for c in fields for n in ("mean", "std", "min", "max")])


def window_summary(windows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Windows by keys: events, means weighted by count, and the mean of the windows' standard deviations."""
    return windows.groupBy(*keys).agg(
        F.sum("count").alias("total_events"),
        *[weighted(F.col(f"{c}_mean"), F.col("count")).alias(f"{c}_mean") for c in fields],
        *[F.avg(f"{c}_std").alias(f"{c}_mean_of_stds") for c in fields],
    )


def gap_filled(rows: DataFrame, key: str, first: int, last: int, fill: object = 0) -> DataFrame:
    """A row for each whole number first to last of key; missing ones are filled."""
    return rows.sparkSession.range(first, last + 1).select(F.col("id").cast(dict(rows.dtypes)[key]).alias(key)).join(rows, key, "left").na.fill(fill)


def error_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, rmse, mae and r2 in one pass. r2 is null where actual doesn't vary."""
    e = F.col(actual) - F.col(predicted)
    return rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.avg(e * e) / F.nullif(F.var_pop(actual), F.lit(0.0))).alias("r2"))


def varying(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with more than one value, nulls aside, from one aggregation."""
    row = rows.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def paired(one: DataFrame, other: DataFrame, label: str, metrics: Sequence[str], names: tuple[str, str] = ("base", "new")) -> DataFrame:
    """Two result sets side by side by label, with each metric's improvement in percent of the first (null where that is 0)."""
    a = one.select(label, *[F.col(m).alias(f"{m}_{names[0]}") for m in metrics])
    b = other.select(label, *[F.col(m).alias(f"{m}_{names[1]}") for m in metrics])
    gain = {f"{m}_gain": (F.col(f"{m}_{names[0]}") - F.col(f"{m}_{names[1]}")) / F.nullif(F.col(f"{m}_{names[0]}").cast("double"), F.lit(0.0)) * 100 for m in metrics}
    return a.join(b, label).withColumns(gain)


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """key and a column for each share: quantiles with interpolation, as a sort of each key's values gives them.

    Values are counted, sorted into ranges side by side and written, so a key with most rows is many tasks'; a value's
    rank is its place in its range after the rows of the ranges before. Nulls don't count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    placed = written(counted.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(key, "_part").agg(F.sum("_n").alias("_size"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.select(key, "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_size").over(Window.partitionBy(key)).alias("_all"))
    within = Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = placed.withColumn("_upto", F.sum("_n").over(within)).join(parts, [key, "_part"]).withColumn("_upto", F.col("_upto") + F.col("_ahead"))
    at = {name: (F.col("_all") - 1) * share for name, share in shares.items()}
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
    ends = {f"_{end}_{name}": F.max(F.when(holds(f(rank)), F.col(value))) for name, rank in at.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = upto.groupBy(key).agg(F.first("_all").alias("_all"), *[c.alias(n) for n, c in ends.items()])
    between = {name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (rank - F.floor(rank)) for name, rank in at.items()}
    return found.select(key, *[c.alias(n) for n, c in between.items()])


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """rows in an order drawn from seed."""
    return rows.orderBy(F.rand(seed))
