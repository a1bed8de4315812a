"""Sharding by global byte-size prefix sums, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import buckets, cut

OWN = ("_part", "_tie", "size", "text_crc32", "shard", "slot")
#: Bytes of documents to a range partition, which has only about 30 of each of them.
RANGE = 4 << 30


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and the columns named in keep): contiguous shards of near equal bytes.

    Rows are ordered by doc_id (nulls first), then checksum, size and place in the input. A row's start is the sum of
    the sizes before it: the totals of the range partitions before its own, plus those before it in its partition. Its
    shard is the part of the whole in which the middle of its bytes lies, so a shard differs from the equal target by
    less than one row. slot numbers a shard's rows from 0.

    The range partitions are written once, since a second sampling of the ranges could cut elsewhere. One window spans
    the partitions' totals (a row each); the others span one partition.

    Null text: size 1, checksum 0. Repeated rows are sharded each on its own. An empty table gives no rows. Columns
    in keep may not be called like those made here.
    """
    if clash := set(keep) & {*OWN, "doc_id"}:
        raise ValueError(f"keep names columns that sharding makes: {sorted(clash)}")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("_tie"), *keep)
    order = ["doc_id", "text_crc32", "size", "_tie"]
    placed = cut(rows.repartitionByRange(buckets(docs, 1, RANGE), *order).withColumn("_part", F.spark_partition_id()))

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    summed = placed.withColumns({"_upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(inside) - 1})
    start = F.col("_bytes_before") + F.col("_upto") - F.col("size")
    # Twice the middle of the row's bytes, times the shards, stays below 2**63 for 100 TB in 20,000 shards.
    cuts = F.expr(f"least({shards - 1}, ((2 * (_bytes_before + _upto) - size) * {shards}) div (2 * _all))").cast("int")
    # One row a partition: at most MOST_BUCKETS, and 25,000 at 100 TB.
    sharded = summed.join(F.broadcast(totals), "_part").withColumns({"_start": start, "shard": cuts, "_number": F.col("_rows_before") + F.col("_nth")})
    firsts = sharded.groupBy("shard").agg(F.min("_number").alias("_first"))  # one row a shard
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_number") - F.col("_first")).cast("long").alias("slot"), *keep)
