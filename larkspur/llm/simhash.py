"""SimHash near-duplicates, found with an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larkspur.llm.common import NO_ID, PACKED, buckets, by_bucket, chunk, cut, documents, in_slices, join_groups, mix, pack, split_by, trimmed, unpack
from larkspur.llm.components import components

#: Words in a shingle, seed of XXH64.
SHINGLE, SEED = 4, 42
BYTES = 8
#: Groups of at most so many fingerprints are compared pair by pair; from SPLIT on they are split first.
SMALL, SPLIT = 16, 2048
#: Fingerprints that a task deals to the index at a time.
AT_ONCE = 8_000
#: Bytes of written fingerprints to a bucket of the index, where each is listed 70 times.
HELD = 4 << 20


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the 64-bit hashes; 0 of none."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(body: bytes) -> int:
    """64 majority bits of the XXH64 of all 4-word shingles, A-Z lower-cased; 0 without words."""
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    span = min(SHINGLE, len(words)) - 1
    ends = stop[span:].tolist()
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends)), np.uint64, len(ends)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(b or b"") for b in batch["body"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], names=["doc_id", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(rows(batches))

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def position_sets(most: int) -> list[np.uint64]:
    """Masks of the sets of byte positions that a pair with at most `most` differing bits must share one of."""
    return [np.uint64(sum(0xFF << 8 * p for p in chosen)) for chosen in combinations(range(BYTES), BYTES - most)]


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes agree, from the exclusive or of two fingerprints."""
    return sum(((x >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(BYTES))


def linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Count filter, then verification."""
    x = a ^ b
    out = shared_bytes(x) >= BYTES - most
    out[out] = np.bitwise_count(x[out]) <= most
    return out


def _span(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (as places) that connect what links connect; a pair already in one group isn't compared."""
    group, out = np.arange(len(fps)), []
    for i in range(len(fps)):
        others = np.flatnonzero(group != group[i])
        if not len(others):
            break
        near = others[linked(fps[others], fps[i], most)]
        if len(near):
            out += [(i, int(j)) for j in near[np.unique(group[near], return_index=True)[1]]]
            group[np.isin(group, group[near])] = group[i]
    return out


def _parts(fps: np.ndarray, n: int) -> list[np.uint64]:
    """Masks that deal the bits in which fps differ to n parts."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    return [np.uint64(sum(1 << b for b in bits[k::n])) for k in range(n)]


def _groups(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """A number for each of n places, equal where edges connect."""
    above = list(range(n))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in edges:
        above[top(a)] = top(b)
    return np.array([top(x) for x in range(n)], np.int64)


def _spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """As _span; a large group is split by each of most + 1 parts of its varying bits, one of which any linked pair shares."""
    if len(fps) <= SPLIT:
        return _span(fps, most)
    edges = []
    for mask in _parts(fps, most + 1):
        at = np.argsort(fps & mask, kind="stable")
        for some in np.split(at, np.flatnonzero(np.diff(fps[at] & mask)) + 1):
            if len(some) > 1:
                edges += [(int(some[a]), int(some[b])) for a, b in _spanning(fps[some], most)]
    last: dict[int, int] = {}
    return [(last.setdefault(g, i), i) for i, g in enumerate(_groups(len(fps), edges).tolist()) if last.setdefault(g, i) != i]


def spanning_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links among distinct fingerprints connect: from each to the least of its group."""
    group = _groups(len(fps), _spanning(fps, most))
    order = np.lexsort((fps, group))
    head = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    least = fps[order][head][np.searchsorted(head, np.arange(len(order)), "right") - 1]
    own = fps[order] != least
    return fps[order][own], least[own]


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that connect all pairs of at most `most` differing bits.

    Such a pair agrees in at least 8 - most positional bytes. The index lists each fingerprint under each set of
    so many positions with their bytes; a list's pairs have passed the count, are counted again and verified. Lists
    of up to SMALL give their pairs, longer ones a spanning forest, so no list gives more than it has members times
    SMALL. A list holds distinct fingerprints, 9 bytes each, however many documents have them.
    """
    n, masks = buckets(distinct, held=HELD), position_sets(most)
    at_once = chunk(AT_ONCE, n)

    def dealt(fps: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        which = np.repeat(np.arange(len(masks)), len(fps))
        every = np.tile(fps, len(masks))
        key = mix(mix((every & np.array(masks, np.uint64)[which])) + which.astype(np.uint64))
        for b, part in split_by((key % np.uint64(n)).astype(np.int64), {"which": which.astype(np.uint8), "fp": every}):
            yield b, 0, pack(**part)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held = []
            for batch in batches:
                held.append(batch["fp"].to_numpy().astype(np.int64).view(np.uint64))
                if sum(map(len, held)) >= at_once:
                    yield from dealt(np.concatenate(held))
                    held = []
            if held:
                yield from dealt(np.concatenate(held))

        return trimmed(in_slices(rows()))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for batch in batches for b in batch["blob"].to_pylist()]
        which, fp = (np.concatenate([p[n] for p in parts]) for n in ("which", "fp"))
        key = fp & np.array(masks, np.uint64)[which]
        order = np.lexsort((fp, key, which))
        which, key, fp = which[order], key[order], fp[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (which[1:] != which[:-1])])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(fp)))
        group = np.cumsum(first) - 1
        few = (size <= SMALL)[group]
        found = []
        for step in range(1, min(SMALL, int(size.max()))):
            at = np.flatnonzero(few[step:] & (group[step:] == group[:-step]))
            at = at[linked(fp[at], fp[at + step], most)]
            found.append((fp[at], fp[at + step]))
        for k in np.flatnonzero(size > SMALL):
            found.append(spanning_links(fp[start[k] : start[k] + size[k]], most))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return by_bucket(distinct.select("fp").mapInArrow(deal, PACKED), n).groupBy("bucket").applyInArrow(match, "a long, b long").distinct()


def simhash_components(docs: DataFrame, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, one row per row of docs.

    Documents link when their fingerprints differ in at most `most` bits; component_id is the smallest doc_id in
    reach. Null and empty texts have fingerprint zero and link like any other. Null doc_ids are behind all others, so a
    component has a null id only if all its rows do. Repeated rows are in one component; a doc_id with several texts
    has a row for each, in the component of each. An empty table gives no rows; further columns stay behind.

    The index, the links and the components are of distinct fingerprints, each of which stands for all its documents,
    however many; a component's smallest doc_id is found when all fingerprints have their component.
    """
    found = cut(fingerprints(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))))
    groups = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    joined = components(cut(links(groups, most))).withColumnRenamed("node", "fp")
    groups = cut(groups.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    firsts = groups.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_members"))
    groups = join_groups(groups.select("fp", "size", "component"), firsts, "component", "_members", groups.count())
    out = join_groups(found, cut(groups.select("fp", "size", "component_id")), "fp", "size", found.count())
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component_id"))


def near_dedup(docs: DataFrame, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of their component: one document of each group.

    Rows equal in doc_id and text are one document, and one of them stays. Rows that share only doc_id stay or go together.
    """
    found = simhash_components(docs, most, id_col, text_col)
    own = "_first"
    while own in docs.columns:
        own = f"_{own}"
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(own)).distinct()
    rows = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    return rows.join(firsts, own, "left_semi").dropDuplicates([own, text_col]).drop(own)
