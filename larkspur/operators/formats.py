"""Storage formats against each other: size on disk and seconds of a full read."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Format, writer options. ORC stands where single-node formats would.
FORMATS = {"parquet": ("parquet", {}), "csv": ("csv", {"header": "true"}), "csv_gz": ("csv", {"header": "true", "compression": "gzip"}), "orc": ("orc", {}), "json": ("json", {})}


def _folder_bytes(df: DataFrame, path: str) -> int:
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def format_benchmark(df: DataFrame, folder: str, names: Sequence[str] = tuple(FORMATS), runs: int = 5) -> DataFrame:
    """format, size_mb, read_time_s (median of runs full reads), rows, columns. Every column of every row is read."""
    spark, out, rows = df.sparkSession, [], df.count()
    for name in names:
        kind, options = FORMATS[name]
        path = f"{folder}/{name}"
        df.write.format(kind).options(**options).mode("overwrite").save(path)
        reader = spark.read.format(kind).schema(df.schema).options(**options)
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            reader.load(path).select(F.xxhash64("*").alias("h")).agg(F.max("h")).collect()
            times.append(time.perf_counter() - start)
        out.append((name, _folder_bytes(df, path) / 1e6, sorted(times)[runs // 2], rows, len(df.columns)))
    return spark.createDataFrame(out, "format string, size_mb double, read_time_s double, rows long, columns int")
