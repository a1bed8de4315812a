"""A session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "larkspur", master: str | None = None, **conf: object) -> SparkSession:
    """UTC, adaptive execution, Arrow; conf names further settings with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings: dict[str, str] = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
