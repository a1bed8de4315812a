"""What the operators share: the cluster's shared folder, packed rows, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shared import own_path, remove_path

#: Rows of the transport format: a bucket, what the blob is, and numpy arrays packed by pack().
PACKED = "bucket int, kind int, blob binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
#: At most so many groups are ever broadcast by join_groups().
HEAVY_GROUPS = 1024
#: What a task holds of a bucket at a time, and a bound on the number of buckets.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 1 << 19
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A null doc_id is ordered behind all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read from there; lost executors don't matter. A table takes
    less room than a checkpoint, is read by column, and can be dropped."""
    path = own_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Removes tables made by cut() that nothing reads any more."""
    for df in cuts:
        remove_path(df.sparkSession, df._larkspur_path)


def forget(spark: SparkSession) -> None:
    """Spark lets go of the broadcasts and shuffles of plans that are gone only when the driver's JVM collects them."""
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The size of what df reads: Catalyst's figures of its plan's leaves, for scans those of their files. Leaves
    without a figure (they show the default, which is next to infinite) count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def buckets(df: DataFrame, each: int = 2, held: int = BUCKET_BYTES) -> int:
    """How many buckets the hashed work of df is dealt to: so many that each has about `held` bytes of what df reads, and
    no fewer than `each` a shuffle partition. Work that unfolds a row into many takes the less of them."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * each
    return max(few, min(input_bytes(df) // held, MOST_BUCKETS)) | 1


def by_bucket(rows: DataFrame, n_buckets: int) -> DataFrame:
    """rows (column bucket) with a bucket's rows in one partition, a partition for each 16 buckets but no fewer than
    spark.sql.shuffle.partitions; grouping by bucket afterwards needs no other shuffle. A task has its buckets one by one."""
    parts = n_buckets // 16
    return rows.repartition(parts, "bucket") if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("bucket")


def chunk(least: int, n_buckets: int) -> int:
    """How many rows a task deals at a time: the more buckets there are, the more, so that packed rows don't get tiny."""
    return min(max(least, n_buckets // 4), 1 << 16)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row a key), safe against hot keys.

    size is a column of groups that bounds the number of rows with the key, total a bound on its sum. Groups with over
    total / HEAVY_GROUPS rows are fewer than HEAVY_GROUPS, so these are broadcast; any other key is too small to
    burden a task of the shuffled join.
    """
    limit = total // HEAVY_GROUPS
    heavy = F.broadcast(groups.where(F.col(size) > limit))
    light = groups.where(F.col(size) <= limit)
    hot = rows.join(heavy, key, "left_semi").join(heavy, key)
    cold = rows.join(heavy, key, "left_anti").join(light, key, "left")
    return hot.unionByName(cold.select(hot.columns))


def few_at_once(spark: SparkSession) -> None:
    """Texts may be very long, so fewer of them travel to Python at once than by default."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, the text as UTF-8 bytes; other columns, whatever their names, stay behind."""
    few_at_once(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _LIBC = None

_packer = zstandard.ZstdCompressor(level=1)
_unpacker = zstandard.ZstdDecompressor()


def pack(**arrays) -> bytes:
    return _packer.compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> dict:
    return pickle.loads(_unpacker.decompress(blob))


def unpack_all(blobs: Iterable[bytes], names: list[str]) -> dict[str, np.ndarray] | None:
    parts = [unpack(b) for b in blobs]
    if not parts:
        return None
    return {n: np.concatenate([p[n] for p in parts]) for n in names}


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], schema=PACKED_ARROW)


def in_slices(rows: Iterable[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Packed rows as record batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield packed_batch(held)
            held, size = [], 0
    if held:
        yield packed_batch(held)


def trimmed(out: Iterator) -> Iterator:
    """out; at its end the worker, which stays for later tasks, gives what it no longer uses back to the system."""
    yield from out
    trim()


def trim() -> None:
    """Gives what this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def split_by(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each bucket that occurs, with its part of each array, order kept."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for at in np.split(order, cuts):
        yield int(bucket[at[0]]), {k: v[at] for k, v in arrays.items()}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
