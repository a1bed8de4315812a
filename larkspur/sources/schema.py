"""Schemas that drift from file to file: unification, alignment, normalising, and a report of the differences."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.tables import side_by_side

_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: null gives way, whole numbers widen, then to double, dates to timestamps, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDTH and type(b) in _WIDTH:
        return a if _WIDTH.index(type(a)) > _WIDTH.index(type(b)) else b
    numbers = (*_WIDTH, T.FloatType, T.DoubleType)
    if type(a) in numbers and type(b) in numbers:
        return T.DoubleType()
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if type(a) in times and type(b) in times:
        return max((a, b), key=lambda t: times.index(type(t)))
    return T.StringType()


def unify(schemas: Iterable[T.StructType]) -> T.StructType:
    """Fields in order of first appearance, each of a type that all files fit; names are case sensitive."""
    found: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema:
            found[field.name] = promoted(found[field.name], field.dataType) if field.name in found else field.dataType
    return T.StructType([T.StructField(n, T.StringType() if isinstance(t, T.NullType) else t) for n, t in found.items()])


def _cast(value: Column, to: T.DataType) -> Column:
    return value.try_cast(to)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema: cast (a value that doesn't fit is null, the rest of its column stays),
    null where missing, dropped where unknown."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select([(_cast(F.col(f"`{f.name}`"), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_drifting(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet files of drifting schemas as one table.

    Footers are read once, several at a time. Files of one schema are read together, so the plan has a scan for each
    schema, not for each file.
    """
    if not paths:
        return spark.createDataFrame([], schema or T.StructType())
    by: dict[str, list[str]] = {}
    kinds: dict[str, T.StructType] = {}
    for path, found in zip(paths, side_by_side(lambda p: spark.read.parquet(p).schema, paths)):
        by.setdefault(found.json(), []).append(path)
        kinds[found.json()] = found
    schema = schema or unify(kinds.values())
    parts = [align(spark.read.schema(kinds[k]).parquet(*files), schema) for k, files in by.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def renamed_first(df: DataFrame, names: Mapping[str, str], drop: Iterable[str] = ()) -> DataFrame:
    """Columns under their canonical names; where several get one name, the first value that isn't null.

    names maps old names to new ones, case sensitively. Old names that end up alike need not be unique in df.
    """
    drop = set(drop)
    old = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(old))])
    into: dict[str, list[str]] = {}
    for i, name in enumerate(old):
        if name not in drop:
            into.setdefault(names.get(name, name), []).append(f"_c{i}")
    return plain.select([(F.coalesce(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])).alias(n) for n, cols in into.items()])


def normalise(df: DataFrame, names: Mapping[str, str], target: T.StructType, pickup: str, file_year: int | None = None, drop: Iterable[str] = ()) -> DataFrame:
    """df as target plus year: that of the pickup, else the file's."""
    out = align(renamed_first(df, names, drop), target)
    ts = F.col(pickup)
    return out.withColumn("year", F.coalesce(F.year(ts), F.lit(file_year).cast("int")))


def first_present(df: DataFrame, candidates: Sequence[str], kind: str = "double") -> Column:
    """The first of the candidate columns that df has, tried as kind; null if it has none."""
    for name in candidates:
        if name in df.columns:
            return F.col(f"`{name}`").try_cast(kind)
    return F.lit(None).cast(kind)


def file_year(path: Column) -> Column:
    """19xx or 20xx in the file's name, else in the nearest folder above; null if there is none."""
    parts = F.reverse(F.split(path, "/"))
    found = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"((?:19|20)\d{2})", 1)), lambda y: y != "")
    return F.get(found, F.lit(0)).cast("int")


def with_file_year(df: DataFrame, name: str = "file_year") -> DataFrame:
    return df.withColumn(name, file_year(F.col("_metadata.file_path")))


def schema_report(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, prefix, error, column, type, status against the first readable file of the prefix.

    status: same, dtype_mismatch, extra or missing; a file that can't be read is one row with its error.
    """

    def probe(path: str) -> list[tuple]:
        prefix = "_".join(path.rstrip("/").rsplit("/", 1)[-1].split("_")[:2])
        try:
            return [(path, prefix, None, f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema]
        except Exception as error:  # noqa: BLE001  the error is the result
            return [(path, prefix, str(error).splitlines()[0][:200], None, None)]

    rows = [row for found in side_by_side(probe, paths) for row in found]
    found = spark.createDataFrame(rows, "file string, prefix string, error string, column string, type string")
    good = found.where("error IS NULL")
    first = good.groupBy("prefix").agg(F.min("file").alias("reference"))
    wanted = good.join(first, "prefix").where(F.col("file") == F.col("reference")).select("prefix", "column", F.col("type").alias("want"))
    files = good.select("prefix", "file").distinct()
    whole = files.join(wanted, "prefix").join(good.select("file", "column", "type"), ["file", "column"], "full_outer")
    status = F.when(F.col("want").isNull(), "extra").when(F.col("type").isNull(), "missing").when(F.col("want") != F.col("type"), "dtype_mismatch").otherwise("same")
    prefix = F.concat_ws("_", F.slice(F.split(F.element_at(F.split("file", "/"), -1), "_"), 1, 2))
    compared = whole.select("file", F.coalesce("prefix", prefix).alias("prefix"), F.lit(None).cast("string").alias("error"), "column", F.coalesce("type", "want").alias("type"), status.alias("status"))
    return compared.unionByName(found.where("error IS NOT NULL").withColumn("status", F.lit("error")))


def missing_names(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key isn't present."""
    return wanted.join(present, key, "left_anti")
