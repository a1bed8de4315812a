"""Near-duplicates by the exact Jaccard similarity of their word shingles.

SimHash's index of byte positions gives the candidates within 4 bits, MinHash bands those that are further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from larkspur.llm.common import NO_ID, PACKED, buckets, cut, documents, drop, in_slices, join_groups, mix, pack, split_by, trimmed, unpack
from larkspur.llm.components import components
from larkspur.llm.simhash import links as near_fingerprints
from larkspur.llm.simhash import majority

#: Words in a shingle; bands and least hashes in each: a pair of similarity 0.8 shares none in 7 of 10**10 cases.
SHINGLE, BANDS, ROWS = 5, 40, 4
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits in which the fingerprints of candidates of the index differ at most.
MOST = 4
#: Texts of a band are compared pair by pair up to so many; a task has at most two blocks of so many about.
SMALL, BLOCK = 16, 2048
#: Texts that a task deals to the index at a time, and shingles that are hashed at a time.
AT_ONCE, HASHED = 8_000, 2048


def shingles(body: bytes) -> np.ndarray:
    """Ascending distinct hashes of all 5-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    span = min(SHINGLE, len(words)) - 1
    ends = stop[span:].tolist()
    return np.unique(np.fromiter((xxh3_64_intdigest(joined[a:b]) for a, b in zip(start.tolist(), ends)), np.uint64, len(ends)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least values that its rows give to the shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), HASHED):
            np.minimum(least, (hashes[at : at + HASHED, None] * _FACTORS).min(axis=0), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            key = mix(key ^ mix(row))
    return key


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets' Jaccard similarity is at least `least`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _node(hashes: np.ndarray) -> int:
    return xxh3_64_intdigest(hashes.tobytes())


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _nodes(docs: DataFrame, with_sets: bool) -> DataFrame:
    """doc_id, node (a hash of the shingles), fp (their SimHash fingerprint), blob: the keys of the bands, or the shingles;
    none for texts without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(b or b"") for b in batch["body"].to_pylist()]
            blobs = [(h if with_sets else bands(h)).tobytes() if len(h) else b"" for h in found]
            fps = [0 if with_sets else majority(h) for h in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _signed([_node(h) for h in found]), _signed(fps), pa.array(blobs, pa.binary())], names=["doc_id", "node", "fp", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(rows(batches))

    return docs.mapInArrow(run, "doc_id long, node long, fp long, blob binary")


def fingerprinted(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of nodes (node, fp) that connect those whose fingerprints differ in at most MOST bits.

    op9's inverted index of byte positions with its count filter finds the fingerprints; the least node of one stands
    for it, and is linked to its others.
    """
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("_size")))
    least = lambda side: firsts.select(F.col("fp").alias(side), F.col("least").alias(f"_{side}"))
    between = near_fingerprints(firsts, MOST).join(least("a"), "a").join(least("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    several = firsts.where("_size > 1")
    within = join_groups(nodes.select("node", "fp").join(several, "fp", "left_semi"), several, "fp", "_size", nodes.count())
    out = cut(between.unionByName(within.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))))
    drop(firsts)
    return out


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b, band: pairs of nodes (node, blob: keys) that share a band; of a band with over SMALL nodes, each with the least."""
    n = buckets(nodes)

    def dealt(node: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        for b, part in split_by((keys % np.uint64(n)).astype(np.int64), {"key": keys, "node": np.repeat(node, BANDS)}):
            yield b, 0, pack(**part)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    some = batch.slice(at, AT_ONCE)
                    yield from dealt(some["node"].to_numpy(), np.frombuffer(b"".join(some["blob"].to_pylist()), np.uint64))

        return trimmed(in_slices(rows()))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for batch in batches for b in batch["blob"].to_pylist()]
        key, node = (np.concatenate([p[c] for p in parts]) for c in ("key", "node"))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start, group = np.flatnonzero(first), np.cumsum(first) - 1
        size = np.diff(np.append(start, len(key)))
        few, found = (size <= SMALL)[group], []
        for step in range(1, min(SMALL, int(size.max()))):
            at = np.flatnonzero(few[step:] & (group[step:] == group[:-step]))
            found.append((node[at], node[at + step]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        rest = np.flatnonzero(~few & ~first)
        band = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(key[rest].view(np.int64))])
        a, b = np.concatenate([pairs[:, 0], node[start[group[rest]]]]), np.concatenate([pairs[:, 1], node[rest]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), band], names=["a", "b", "band"])

    return nodes.select("node", "blob").mapInArrow(deal, PACKED).groupBy("bucket").applyInArrow(match, "a long, b long, band long")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, blob) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return trimmed(rows())

    total, out, helds = pairs.count(), pairs, []
    for side, name in (("a", "x"), ("b", "y")):
        degree = pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("_degree"))
        held = cut(sets.join(degree, "node").select(F.col("node").alias(side), F.col("blob").alias(name), "_degree"))
        helds.append(held)
        out = join_groups(out, held, side, "_degree", total).drop("_degree")
    out = cut(out.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    drop(*helds)
    return out


def spanning(sets: list[np.ndarray], group: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all groups that similar sets connect; a pair already in one isn't compared."""
    size, flat, out, group = np.array(list(map(len, sets))), np.concatenate(sets), [], group.copy()
    owner = np.repeat(np.arange(len(sets)), size)
    for i, own in enumerate(sets):
        others = (group != group[i]) & (size >= least * len(own) - 1e-9) & (len(own) >= least * size - 1e-9)
        if not others.any():
            continue
        at = others[owner]
        some, whose = flat[at], owner[at]
        hit = own[np.minimum(np.searchsorted(own, some), len(own) - 1)] == some
        both = np.bincount(whose[hit], minlength=len(sets))
        for j in np.flatnonzero(others & (both >= least * (size + len(own) - both) - 1e-9)):
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def _rest_links(members: DataFrame, open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links that connect the components that similar members (band, node, component) of open bands (band, _members)
    connect.

    A band of over BLOCK members is dealt to blocks, and each two blocks meet in a task, so no task has more than two
    blocks' sets, however large the band is.
    """

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        found = spanning([np.frombuffer(x, np.uint64) for x in table["blob"].to_pylist()], np.unique(table["component"].to_numpy(), return_inverse=True)[1], least)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    rows = join_groups(members, open_, "band", "_members", members.count()).where("_members IS NOT NULL")
    n = F.ceil(F.col("_members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.select("band", "node", "component", F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"))
    return rows.join(sets, "node").groupBy("band", "_one", "_two").applyInArrow(run, "a long, b long")


def similar_dedup(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of their component: one document of each group.

    Documents link when the Jaccard similarity of their sets of 5-word shingles is at least `least` (0.8 or more);
    components are all that links connect. Shingles are known by 64-bit hashes. Candidates have SimHash fingerprints
    (of these shingles) within 4 bits, found with the index of byte positions, or, as most sets of similarity 0.8 are
    further apart, share one of 40 MinHash bands. Each link is verified on whole sets. A band with over SMALL sets gives
    its members' pairs with the least one; if these don't connect it, its members are compared where links of either
    kind don't connect them yet, in blocks.

    Texts without words link to each other alone. Null doc_ids are behind all others. Rows equal in doc_id and text are
    one document, and one of them stays; rows that share only doc_id stay or go together. An empty table gives no rows.
    """
    if least < 0.8:
        raise ValueError("the bands are made for similarities from 0.8 on")
    own = "_first"
    while own in docs.columns:
        own = f"_{own}"
    plain = documents(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = cut(_nodes(plain, False).groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("blob").alias("blob")))
    worded = found.where(F.length("blob") > 0)
    close, near = fingerprinted(worded), cut(candidates(worded))
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = cut(close.select(*ends).unionByName(near.select(*ends)).distinct())
    wanted = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    some = plain.join(found.join(wanted, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = cut(_nodes(some, True).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("blob").alias("blob")))
    links = _verified(pairs, sets, least)
    joined = cut(components(links))
    large = near.where("band IS NOT NULL")
    if not large.isEmpty():
        members = large.select("band", F.col("a").alias("node")).unionByName(large.select("band", F.col("b").alias("node"))).distinct()
        members = cut(members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
        ends = members.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_members"))
        more = cut(_rest_links(members, ends.where("_low < _high").select("band", "_members"), sets, least))
        if not more.isEmpty():
            joined = cut(components(links.unionByName(more).distinct()))
        drop(members, more)
    drop(close, near, pairs, wanted, sets, links)
    groups = found.select("node", "first").join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    firsts = groups.agg(F.min("first").alias(own)).select(own).distinct()
    rows = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    return rows.join(firsts, own, "left_semi").dropDuplicates([own, text_col]).drop(own)
