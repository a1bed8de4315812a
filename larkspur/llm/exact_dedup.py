"""Exact deduplication with a cuckoo-filter index over digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import NO_ID, buckets, cut, documents, join_groups

#: Characters that don't count, as bytes: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
SLOTS, KICKS = 4, 200
#: Bytes of written digests whose index a task holds; there it takes about ten times as much.
HELD = 16 << 20


class CuckooFilter:
    """Marks of 16 bits in buckets of four, each in one of two buckets: may say yes wrongly, never no."""

    def __init__(self, size: int):
        self.size = size
        self.table: list[list[int]] = [[] for _ in range(size)]

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """The digest's mark and its two buckets."""
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & (self.size - 1)
        return mark, one, self._other(one, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995 >> 3)) & (self.size - 1)

    def has(self, digest: bytes) -> bool:
        mark, one, two = self.places(digest)
        return mark in self.table[one] or mark in self.table[two]

    def insert(self, digest: bytes) -> bool:
        """False if it overflows: after KICKS moves a mark is without a place, and the filter must be made anew."""
        mark, one, two = self.places(digest)
        at = one if len(self.table[one]) <= len(self.table[two]) else two
        for kick in range(KICKS):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
            turn = kick % SLOTS
            mark, self.table[at][turn] = self.table[at][turn], mark
            at = self._other(at, mark)
        return False

    def delete(self, digest: bytes) -> None:
        """digest must have been inserted; of equal marks any may go."""
        mark, one, two = self.places(digest)
        self.table[one if mark in self.table[one] else two].remove(mark)


class CuckooIndex:
    """Live digests: a cuckoo filter of short marks in front of the stored content.

    A miss in the filter proves that a digest is new, and the store isn't touched. A hit may be false, so it is
    verified against the content: whole digests with their values, in buckets of their own, which kicks don't move.
    Deletion takes the mark and the content. When the filter overflows, it doubles and is refilled from the stored keys.
    """

    def __init__(self, size: int = 64):
        self.filter = CuckooFilter(1 << max(1, (size - 1).bit_length()))
        self.content: dict[int, list[tuple[bytes, list]]] = {}
        self.live = 0
        self.false_hits = 0

    @staticmethod
    def _bucket(digest: bytes) -> int:
        return int.from_bytes(digest[10:16], "little")

    def get(self, digest: bytes) -> list | None:
        """What is stored for digest, or None."""
        if not self.filter.has(digest):
            return None
        for key, value in self.content.get(self._bucket(digest), ()):
            if key == digest:
                return value
        self.false_hits += 1
        return None

    def insert(self, digest: bytes, value: list) -> None:
        """digest must not be live."""
        self.content.setdefault(self._bucket(digest), []).append((digest, value))
        self.live += 1
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        if self.get(digest) is None:
            return False
        at = self._bucket(digest)
        left = [x for x in self.content.pop(at) if x[0] != digest]
        if left:
            self.content[at] = left
        self.filter.delete(digest)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content.values():
            yield from bucket

    def _resize(self) -> None:
        size = self.filter.size
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(key) for key, _ in self.items()):
                return


def _better(a: list, b: list) -> bool:
    """More code points, then the smaller doc_id, then the row that was read first."""
    return (-a[0], a[1], a[2]) < (-b[0], b[1], b[2])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row numbers the rows, as nothing else may tell them apart; the result is written once, so it stays as it is."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        digests = [hashlib.sha256((b or b"").translate(None, SPACE)).digest() for b in batch["body"].to_pylist()]
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["points"], rows, pa.array(digests, pa.binary())], names=["doc_id", "points", "row", "digest"])


def _gather(index: CuckooIndex, digests, points, ids, rows, counts) -> None:
    for digest, *new, count in zip(digests, points, ids, rows, counts):
        old = index.get(digest)
        if old is None:
            index.insert(digest, [*new, count])
            continue
        count += old[3]
        if _better(new, old):  # the row that stood for this digest goes, the better one is live from now on
            index.delete(digest)
            index.insert(digest, [*new, count])
        else:
            old[3] = count


GROUPS = "digest binary, points long, keep_id long, keep_row long, group_size long"
COLUMNS = [part.split()[0] for part in GROUPS.split(", ")]


def _table(index: CuckooIndex) -> pa.RecordBatch:
    rows = [(k, *v) for k, v in index.items()]
    cols = list(zip(*rows)) if rows else [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.binary()) for i, c in enumerate(cols)], names=COLUMNS)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one partition of documents, a bounded number at a time: a hot text leaves it as few rows."""
    index = CuckooIndex()
    for batch in batches:
        _gather(index, *(batch[c].to_pylist() for c in ("digest", "points", "doc_id", "row")), [1] * batch.num_rows)
        if index.live > 100_000:
            yield _table(index)
            index = CuckooIndex()
    yield _table(index)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one range of digests: a partition of the shuffled local groups has all rows of its digests."""
    index = CuckooIndex()
    for batch in batches:
        _gather(index, *(batch[c].to_pylist() for c in COLUMNS))
    yield _table(index)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty. The row with most
    code points in the original text stays, then the smallest doc_id (null: behind all others). Of rows that agree in
    both, whether their texts differ in white space or not at all, one stays: exactly one row of each group has kept
    set. Texts of any length are hashed whole; further columns stay behind, and an empty table gives no rows.

    Each partition of documents groups its digests in a cuckoo index of its own; the groups are dealt by digest, and
    each task merges its digests in an index that holds them alone; how many tasks follows the size of the digests.
    A hot text reaches its task as one row from each partition. The documents then meet their groups by join_groups().
    """
    plain = documents(docs, id_col, text_col).withColumns({"doc_id": F.coalesce("doc_id", F.lit(NO_ID)), "points": F.coalesce(F.length(F.col("body").cast("string")), F.lit(0)).cast("long")})
    rows = cut(plain.mapInArrow(_digests, "doc_id long, points long, row long, digest binary"))
    groups = cut(rows.mapInArrow(_local, GROUPS).repartition(buckets(rows, 1, HELD), "digest").mapInArrow(_whole, GROUPS))
    out = join_groups(rows, groups.drop("points"), "digest", "group_size", rows.count())
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        real("doc_id").alias("doc_id"),
        real("keep_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
