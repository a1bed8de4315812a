"""The tables as trip records, and how queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.tables import load

#: Zones of a trip: the nations of its supplier and of its customer, joined only where a query asks for them.
PU, DO = "pu", "do"


def trips_sql(*roles: str) -> str:
    """The same records as trips() in SQL, as a WITH part; queries put their own parts behind it."""
    zones = {PU: ("s.s_nationkey AS pu_zone", "JOIN supplier s ON l.l_suppkey = s.s_suppkey"), DO: ("c.c_nationkey AS do_zone", "JOIN customer c ON o.o_custkey = c.c_custkey")}
    columns, joins = "".join(f", {zones[r][0]}" for r in roles), " ".join(zones[r][1] for r in roles)
    return f"""WITH trips AS (
    SELECT o.o_orderdate AS pickup, l.l_shipdate AS dropoff, l.l_extendedprice AS fare, l.l_quantity AS distance, l.l_linenumber::DOUBLE AS passengers, l.l_discount AS tip,
           l.l_returnflag AS operator, l.l_linestatus AS shared, o.o_orderpriority AS service, l.l_orderkey AS trip_id{columns}
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey {joins})"""


def trips(spark: SparkSession, folder: str, *roles: str) -> DataFrame:
    """Line items as trips: ordered is picked up, shipped is dropped off.

    All tables grow with the data, so no join is forced: Catalyst broadcasts what its statistics allow.
    """
    rows = load(spark, folder, "lineitem").join(load(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if PU in roles:
        rows = rows.join(load(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("pu_zone")), F.col("l_suppkey") == F.col("s_suppkey"))
    if DO in roles:
        rows = rows.join(load(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("do_zone")), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderdate").alias("pickup"),
        F.col("l_shipdate").alias("dropoff"),
        F.col("l_extendedprice").alias("fare"),
        F.col("l_quantity").alias("distance"),
        F.col("l_linenumber").cast("double").alias("passengers"),
        F.col("l_discount").alias("tip"),
        F.col("l_returnflag").alias("operator"),
        F.col("l_linestatus").alias("shared"),
        F.col("o_orderpriority").alias("service"),
        F.col("l_orderkey").alias("trip_id"),
        *[f"{r}_zone" for r in roles],
    )


def registrar() -> tuple[dict, dict, Callable]:
    """Queries and SQL of a module, and the decorator that fills them."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
