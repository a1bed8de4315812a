import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources import schema, sinks, tables


def _type(name):
    return T.StructType.fromDDL(f"x {name}")[0].dataType


@pytest.mark.parametrize("a,b,c", [("int", "bigint", "bigint"), ("bigint", "double", "double"), ("float", "double", "double"), ("int", "string", "string"), ("date", "timestamp_ntz", "timestamp_ntz"), ("void", "double", "double"), ("boolean", "int", "string"), ("int", "int", "int")])
def test_promotion(spark, a, b, c):
    assert schema.promoted(_type(a), _type(b)) == schema.promoted(_type(b), _type(a)) == _type(c)


def test_drifting_files(spark, tmp_path):
    parts = {"a": "SELECT 1 AS id, 'x' AS s", "b": "SELECT 2L AS id, 5 AS s, 1.5D AS extra", "c": "SELECT 3.5D AS id"}
    for name, sql in parts.items():
        spark.sql(sql).write.parquet(str(tmp_path / name))
    found = schema.read_drifting(spark, [str(tmp_path / n) for n in parts])
    assert found.dtypes == [("id", "double"), ("s", "string"), ("extra", "double")]
    assert sorted(map(tuple, found.collect())) == [(1.0, "x", None), (2.0, "5", 1.5), (3.5, None, None)]


def test_cast_nulls_the_value_alone(spark):
    df = spark.createDataFrame([("CMT", "7"), ("1", "x")], "vendor string, other string")
    out = schema.align(df, T.StructType.fromDDL("vendor double, missing int"))
    assert sorted(map(tuple, out.collect()), key=repr) == [(1.0, None), (None, None)]


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double").toDF("airport_fee", "Airport_fee")
    assert sorted(r.fee for r in schema.renamed_first(df, {"airport_fee": "fee", "Airport_fee": "fee"}).collect()) == [1.0, 2.0]


def test_normalise_takes_the_files_year(spark):
    df = spark.createDataFrame([("2010-02-28 23:59:59", "1"), ("garbage", "2")], "pickup string, id string")
    out = schema.normalise(df, {"pickup": "pickup_at"}, T.StructType.fromDDL("pickup_at timestamp, id long"), "pickup_at", 2009)
    assert sorted((r.id, r.year) for r in out.collect()) == [(1, 2010), (2, 2009)]


def test_year_in_paths(spark):
    paths = ["/d/2018/green_2019-03.parquet", "/d/2018/part-0.parquet", "/d/year=2021/p.parquet", "/d/none"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select(schema.file_year(F.col("p")).alias("y"))
    assert [r.y for r in found.collect()] == [2019, 2018, 2021, None]


def test_report(spark, tmp_path):
    for name, sql in {"green_trips_1": "SELECT 1 AS a, 2 AS b", "green_trips_2": "SELECT 1L AS a, 3 AS c"}.items():
        spark.sql(sql).write.parquet(str(tmp_path / name))
    (tmp_path / "green_trips_3").write_text("no parquet")
    rows = schema.schema_report(spark, [str(tmp_path / f"green_trips_{i}") for i in (1, 2, 3)]).collect()
    found = {(r.file[-1], r.column, r.status) for r in rows}
    assert found == {("1", "a", "same"), ("1", "b", "same"), ("2", "a", "dtype_mismatch"), ("2", "b", "missing"), ("2", "c", "extra"), ("3", None, "error")}
    assert {r.prefix for r in rows} == {"green_trips"}


def test_first_present(spark):
    df = spark.createDataFrame([("5",)], "fare string")
    assert df.select(schema.first_present(df, ["fare_amount", "fare"]).alias("f")).first().f == 5.0
    assert df.select(schema.first_present(df, ["none"]).alias("f")).first().f is None


def test_partitioned_write_and_pruned_read(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(2000 + id % 4 as int) AS year")
    for n in (1, 3):
        path = str(tmp_path / f"t{n}")
        sinks.write_partitioned(df, path, files_per_value=n)
        part = tables.partitions_between(spark, path, 2001, 2002)
        assert part.count() == 50 and "PartitionFilters: [isnotnull(year" in part._jdf.queryExecution().toString()


def test_ordered_csv_json_and_stats(spark, tmp_path):
    df = spark.createDataFrame([(3, float("nan")), (1, None), (2, 0.5)], "k int, v double")
    sinks.write_ordered(df, str(tmp_path / "o"), "k", one_file=True)
    assert [r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1, 2, 3]
    sinks.write_csv(df, str(tmp_path / "c"), gzip=True)
    assert tables.read_csv(spark, str(tmp_path / "c"), "k int, v double").count() == 3
    sinks.write_json(df, str(tmp_path / "j"))
    assert tables.read_ndjson(spark, str(tmp_path / "j"), "k int, v double").count() == 3
    assert sorted(r.value for r in sinks.messages(df, "k").collect()) == ['{"k":1,"v":null}', '{"k":2,"v":0.5}', '{"k":3,"v":null}']
    assert [r["rows"] for r in tables.file_stats(spark.read.parquet(str(tmp_path / "o"))).collect()] == [3]


def test_json_documents(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"hourly": {"time": ["a", "b"], "t": [1.5, 2.5]}}')
    found = tables.read_json_documents(spark, str(tmp_path / "w.json"), "hourly struct<time:array<string>,t:array<double>>")
    assert [tuple(r) for r in tables.parallel_arrays(found, "hourly", {"time": "hour", "t": "temperature"}).collect()] == [("a", 1.5), ("b", 2.5)]


def test_table(spark):
    sinks.write_table(spark.range(3), "larkspur_test_table")
    assert spark.table("larkspur_test_table").count() == 3
    spark.sql("DROP TABLE larkspur_test_table")


def test_missing_names(spark):
    from larkspur.functions.dates import months

    wanted = months(spark, "2019-11-01", "2020-02-01")
    assert [r.month for r in schema.missing_names(wanted, wanted.where("month <> '2020-01-01'"), "month").collect()] == [dt.date(2020, 1, 1)]


def test_row_groups_and_reset(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    files = [r.file for r in tables.file_stats(spark.read.parquet(str(tmp_path / "p"))).collect()]
    assert tables.row_groups(spark, files).first()["rows"] == 100
    sinks.reset(spark, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()


def test_temporary_paths_go(spark):
    from larkspur.sources.shared import own_path, temporary, written

    stays = own_path(spark, "stays")
    with temporary(spark):
        kept = written(spark.range(5))
        kept.selectExpr("id * 2 AS id").write.parquet(stays)
        inside = kept.inputFiles()[0].removeprefix("file://")
    assert spark.read.parquet(stays).count() == 5
    with pytest.raises(Exception):
        open(inside)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from larkspur.sources import shared

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://far:7077", "applicationId": "x", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Far)
