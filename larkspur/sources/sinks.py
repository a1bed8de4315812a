"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str = "year", rows_per_file: int | None = None, files_per_value: int = 1) -> None:
    """Parquet folders by=value. A value's rows go to files_per_value tasks, so a value with most rows isn't one task's."""
    dealt = df.repartition(by) if files_per_value == 1 else df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value))).repartition(by, "_salt").drop("_salt")
    writer = dealt.write.partitionBy(by).mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_ordered(df: DataFrame, path: str, *order: str, one_file: bool = False) -> None:
    """Parquet with zstd whose files, in order of their names, are in order; one_file is for small tables."""
    ordered = df.coalesce(1).sortWithinPartitions(*order) if one_file else df.orderBy(*order)
    ordered.write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False, one_file: bool = True) -> None:
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def as_json(df: DataFrame, keep_nulls: bool = True) -> Column:
    """Each row as JSON text: NaN becomes null, and nulls are written."""
    cells = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": str(not keep_nulls).lower()})


def messages(df: DataFrame, key: str) -> DataFrame:
    """key and value columns as a topic wants them; the key is a whole number's text."""
    return df.select(F.col(key).cast("long").cast("string").alias("key"), as_json(df).alias("value"))


def to_topic(stream: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Appends a stream's rows to a topic as keyed JSON. Needs Spark's Kafka package."""
    return messages(stream, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).outputMode("append").start()


def to_console(stream: DataFrame, checkpoint: str, rows: int = 20):
    return stream.writeStream.format("console").option("numRows", rows).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def reset(spark: SparkSession, *paths: str) -> None:
    """Removes outputs and checkpoints, so that a stream starts from its beginning."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
