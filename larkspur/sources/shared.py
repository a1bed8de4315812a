"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Lists that own_path() adds to, one for each temporary() that is open.
_WATCHED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master (tests) gets an own folder; on a cluster, whose
    executors share no local folder, it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="larkspur-")
        named = _LOCAL[sc.applicationId]
    return named


def own_dir(spark: SparkSession) -> str:
    """What this application leaves there."""
    return f"{shared_dir(spark)}/larkspur-{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else has."""
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _WATCHED:
        paths.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """At its end, all paths that own_path() gave out within are removed: what is to stay must be written elsewhere."""
    paths: list[str] = []
    _WATCHED.append(paths)
    try:
        yield
    finally:
        _WATCHED[:] = [x for x in _WATCHED if x is not paths]
        for path in paths:
            remove_path(spark, path)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, computed once, written to the shared folder and read from there; lost executors don't matter."""
    path = own_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has left in the shared folder; results that read it are lost."""
    remove_path(spark, own_dir(spark))
