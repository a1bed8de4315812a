"""Zone-hour demand, its features, and models that predict it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import dow_monday
from larkspur.operators.aggregates import error_metrics
from larkspur.sources.shared import written

#: Names of the model's inputs that come from a trip's time alone.
BASE_FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "year_norm", "is_weekend", "is_rush_hour", "is_covid")
#: The inputs that need no other table but weather.
FEATURES = (*BASE_FEATURES, "is_raining")


def zone_hour_demand(trips: DataFrame, zone: str, ts: str, constants: Sequence[str] = (), *keys: str) -> DataFrame:
    """trip_count by zone, year, month, day, hour and day of the week (Monday 0); rows without zone or time don't count.

    constants are columns that depend on the key alone; their largest value stands for them.
    """
    t = F.col(ts)
    by = [F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), dow_monday(t).alias("dow")]
    return trips.where(F.col(zone).isNotNull() & t.isNotNull()).groupBy(*keys, zone, *by).agg(F.count("*").alias("trip_count"), *[F.max(c).alias(c) for c in constants])


def demand_features(demand: DataFrame, first_year: int = 2021, rain: str | None = None, precipitation: str | None = None) -> DataFrame:
    """demand with cyclic time, trend, flags, and target: log1p of the count."""
    turn = lambda c, period: 2 * 3.141592653589793 * F.col(c) / period
    # The hours, days and months of the flags.
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    year, month, hour = F.col("year"), F.col("month"), F.col("hour")
    wet = F.coalesce(*[F.col(c) for c in (rain, precipitation) if c], F.lit(0.0)) > 0.5
    return demand.withColumns({
        **{f"{c}_{n}": f(turn(c, p)) for c, p in (("hour", 24), ("dow", 7), ("month", 12)) for n, f in (("sin", F.sin), ("cos", F.cos))},
        "year_norm": (year - first_year) / 2.0,
        "is_weekend": flag(F.col("dow") >= 5),
        "is_rush_hour": flag(hour.between(7, 9) | hour.between(17, 19)),
        "is_covid": flag(((year == 2020) & (month >= 3)) | ((year == 2021) & (month <= 6))),
        "is_raining": flag(wet),
        "target": F.log1p(F.greatest(F.col("trip_count"), F.lit(0)).cast("double")),
    })


def _matrix(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def filled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with all features as doubles; nulls and missing columns are 0."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in features})


def fit_linear(rows: DataFrame, features: Sequence[str], target: str = "target") -> PipelineModel:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = LinearRegression(featuresCol="scaled", labelCol=target, solver="l-bfgs", maxIter=300, tol=1e-4, regParam=1e-6)
    return Pipeline(stages=[_matrix(features), scaler, model]).fit(filled(rows, features))


def fit_boosted(rows: DataFrame, features: Sequence[str], target: str = "target", rounds: int = 200, seed: int = 42) -> PipelineModel:
    model = GBTRegressor(featuresCol="features", labelCol=target, maxDepth=6, stepSize=0.08, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, maxIter=rounds, seed=seed)
    return Pipeline(stages=[_matrix(features), model]).fit(filled(rows, features))


def _descend(x: np.ndarray, y: np.ndarray, weights: np.ndarray, rate: float, penalty: float, batch: int) -> tuple[np.ndarray, float]:
    """One pass over a chunk in steps of a few rows; the last weight is the bias. Returns them and the sum of squared errors."""
    total = 0.0
    for at in range(0, len(y), batch):
        some = x[at : at + batch]
        error = some @ weights - y[at : at + batch]
        total += float(error @ error)
        step = some.T @ error / len(error)
        step[:-1] += penalty * weights[:-1]
        weights = weights - rate * step
    return weights, total


def fit_sgd(rows: DataFrame, features: Sequence[str], target: str = "target", epochs: int = 5, rate: float = 0.01, chunk: int = 200_000, batch: int = 16, penalty: float = 1e-4, test: DataFrame | None = None) -> dict[str, object]:
    """Linear weights by stochastic descent over standardised features, in chunks and epochs.

    In an epoch each task takes its rows in chunks of up to `chunk`, permutes each by the epoch's seed, and goes on from
    the epoch's weights; the tasks' weights are averaged by their rows. The rate adapts: it is a fifth from then on when
    an epoch doesn't lower the training error. Means and deviations are those of all rows. Rows are read once an epoch
    from a written table; the driver sees a row of weights a task. Returns weights, bias, means, stds, rates, the
    training error (mean square) of each epoch and, with test, its root mean square error after each epoch.
    """
    data = written(filled(rows, features).select(*features, F.col(target).cast("double").alias("_y")))
    stats = data.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = np.array([stats[f"m{i}"] or 0.0 for i in range(len(features))])
    stds = np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))])
    weights, losses, rates, tested = np.zeros(len(features) + 1), [], [], []

    def epoch_of(epoch: int, weights: np.ndarray, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            draw, own, total, n, held, size = np.random.default_rng((epoch, task)), weights, 0.0, 0, [], 0

            def pass_over() -> None:
                nonlocal own, total, n, held, size
                block = np.concatenate(held)
                block = block[draw.permutation(len(block))]
                x = np.column_stack([(block[:, :-1] - means) / stds, np.ones(len(block))])
                own, lost = _descend(x, block[:, -1], own, rate, penalty, batch)
                total, n, held, size = total + lost, n + len(block), [], 0

            for rows_ in batches:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in rows_.columns]))
                size += rows_.num_rows
                if size >= chunk:
                    pass_over()
            if size:
                pass_over()
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([n]), pa.array([total]), pa.array([own.tolist()])], names=["task", "n", "total", "weights"])

        return run

    best = float("inf")
    for epoch in range(epochs):
        parts = [r for r in data.mapInArrow(epoch_of(epoch, weights, rate), "task long, n long, total double, weights array<double>").orderBy("task").collect() if r.n]
        if not parts:
            break
        n = sum(r.n for r in parts)
        weights = sum(np.array(r.weights) * (r.n / n) for r in parts)
        losses.append(sum(r.total for r in parts) / n)
        rates.append(rate)
        if test is not None:
            model = {"weights": weights[:-1].tolist(), "bias": float(weights[-1]), "means": means.tolist(), "stds": stds.tolist()}
            tested.append(error_metrics(predict_sgd(test, model, features), target, "prediction").first()["rmse"])
        if losses[-1] >= best:
            rate /= 5
        best = min(best, losses[-1])
    return {"weights": weights[:-1].tolist(), "bias": float(weights[-1]), "means": means.tolist(), "stds": stds.tolist(), "losses": losses, "rates": rates, "tested": tested}


def predict_sgd(rows: DataFrame, model: Mapping[str, list[float]], features: Sequence[str]) -> DataFrame:
    terms = [(F.col(c) - m) / s * w for c, m, s, w in zip(features, model["means"], model["stds"], model["weights"])]
    return filled(rows, features).withColumn("prediction", sum(terms, F.lit(model["bias"])))


def evaluate(predicted: DataFrame, target: str = "target") -> DataFrame:
    """Metrics on the scale of counts; predictions below 0 count as 0."""
    scaled = predicted.select(F.expm1(target).alias("_a"), F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("_p"))
    return error_metrics(scaled, "_a", "_p")


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by importance in a boosted model, largest first, under their own names."""
    return sorted(zip(features, map(float, model.stages[-1].featureImportances)), key=lambda p: (-p[1], p[0]))


def compare(train: DataFrame, test: DataFrame, key: str, values: Sequence[str], features: Sequence[str], base: Sequence[str], fit: Callable[[DataFrame, Sequence[str], int], PipelineModel], rounds: tuple[int, int] = (200, 150)) -> DataFrame:
    """label, n, rmse, mae, r2 of: one model for all (unified); one for each value of key, and these together
    (separate); one for all without the added features (base).

    key's value is an input of the models for all, as a whole number. The first of rounds is for the unified model, the
    second for the others. A value without rows to learn from or to test on gives no row of its own. The models are
    independent, so they are fitted side by side.
    """
    spark = train.sparkSession
    code = F.lit(-1)
    for i, v in enumerate(values):
        code = F.when(F.col(key) == v, i).otherwise(code)
    every = [*features, "_code"]
    train, test = (written(filled(d.withColumn("_code", code), every).select(key, "target", *every)) for d in (train, test))
    both = [train.groupBy(key).count(), test.groupBy(key).count()]
    have = set.intersection(*[{r[key] for r in d.collect()} for d in both])  # a row for each value
    jobs = {"unified": (F.lit(True), every, rounds[0]), "base": (F.lit(True), [*base, "_code"], rounds[1])}
    jobs |= {f"only {v}": (F.col(key) == v, list(features), rounds[1]) for v in values if v in have}

    def run(job: tuple) -> DataFrame:
        where, names, n = job
        return fit(train.where(where), names, n).transform(filled(test.where(where), names)).select("target", "prediction")

    with ThreadPoolExecutor(len(jobs)) as pool:
        found = dict(zip(jobs, pool.map(inheritable_thread_target(spark)(run), jobs.values())))
    parts = [d for label, d in found.items() if label.startswith("only ")]
    if parts:
        found["separate"] = reduce(DataFrame.unionByName, parts)
    return reduce(DataFrame.unionByName, [evaluate(d).select(F.lit(label).alias("label"), "*") for label, d in found.items()])
