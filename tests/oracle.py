"""Runs a query's SQL in DuckDB and compares rows, whatever their order."""

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def same(spark_df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(spark_df.columns) == sorted(names)
    mine, theirs = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, found.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not different, different[:3]
    return len(mine)
