"""Readers: tables of a folder, delimited text, JSON lines and documents, parallel arrays, Kafka."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header, plain or gzipped; without a schema types are inferred, which costs a pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Files that hold one JSON value each: a record or a list of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def parallel_arrays(df: DataFrame, struct: str, names: dict[str, str]) -> DataFrame:
    """Rows of a struct of equally long arrays; names maps array fields to columns."""
    arrays = F.arrays_zip(*[F.col(f"{struct}.{old}").alias(new) for old, new in names.items()])
    return df.select(F.explode(arrays).alias("_r")).select([F.col(f"_r.{new}").alias(new) for new in names.values()])


def partitions_between(spark: SparkSession, path: str, first: int, last: int, column: str = "year") -> DataFrame:
    """The partitions first to last of a table partitioned by column; others are never listed in a task."""
    return spark.read.parquet(path).where(F.col(column).between(first, last))


def file_stats(df: DataFrame) -> DataFrame:
    """file, rows and bytes of the files that df reads."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count("*").alias("rows"))


def kafka_json(spark: SparkSession, servers: str, topic: str, schema: str, event_time: str, offsets: str = "earliest") -> DataFrame:
    """A topic's JSON values as columns, with ts: the event's own time, else the broker's. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets).load()
    rows = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), "timestamp")
    return rows.select("v.*", F.coalesce(F.try_to_timestamp(F.col(f"v.{event_time}")), F.col("timestamp")).alias("ts"))


def side_by_side(probe: Callable[[str], object], paths: Sequence[str], at_once: int = 16) -> list:
    """probe of each path, in their order, so many at a time: footers are small, what takes time is the waiting."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(probe, paths))


def row_groups(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, row_groups, rows of Parquet files, from their footers alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def probe(path: str) -> tuple[str, int, int]:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
        try:
            return path, reader.getRowGroups().size(), reader.getRecordCount()
        finally:
            reader.close()

    return spark.createDataFrame(side_by_side(probe, paths), "file string, row_groups int, rows long")
