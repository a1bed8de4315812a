"""Connected components by smallest node, without gathering links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, drop, forget, join_groups

#: Links that a task contracts at a time.
AT_ONCE = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least node of each group that the links connect to its others."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    above = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x < y:
            above[y] = x
        elif y < x:
            above[x] = y
    for i, x in enumerate(above):  # those above are smaller, so they are settled before
        above[i] = above[x]
    top = np.array(above, np.int64)
    own = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[top[own]], nodes[own]


def contracted(links: DataFrame) -> DataFrame:
    """Links that connect what links connect: each task makes stars of its own, AT_ONCE links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = _stars(*(np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                yield stars(held)
                held, size = [], 0
        if held:
            yield stars(held)

    return links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component of each node that has a link: the smallest node in reach. One row a node.

    links: a, b (each link once, in either direction). Tasks first make stars of the links they have, which shortens all
    ways. Nodes are their own labels, so a label names one node. In each round a node takes the least label of its neighbours, then the label of the node so named (pointer jumping), until
    nothing changes: the rounds follow the logarithm of a component's diameter. Hubs and labels of large components
    are hot keys; both joins are join_groups(). Nulls aren't nodes; no links give no rows.
    """
    fewer = contracted(links)
    both = cut(fewer.withColumn("_ends", F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).select(F.inline("_ends")).distinct())
    total = both.count()
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")).withColumn("label", F.col("node")))
    while total:
        heard = join_groups(both, labels.select(F.col("node").alias("a"), "label", "degree"), "a", "degree", total)
        heard = heard.groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_heard"))
        told = cut(labels.select("node", "degree", "label").join(heard, "node").withColumn("_new", F.least("label", "_heard")))
        drop(labels)
        named = told.groupBy("_new").agg(F.count("*").alias("_size"))
        jumps = named.join(told.select(F.col("node").alias("_new"), F.col("_new").alias("_next")), "_new")
        jumped = join_groups(told, jumps, "_new", "_size", total)
        labels = cut(jumped.select("node", "degree", F.col("_next").alias("label"), (F.col("_next") < F.col("label")).alias("_changed")))
        drop(told)
        if labels.where("_changed").isEmpty():
            break
    drop(both)
    forget(links.sparkSession)
    return labels.select("node", F.col("label").alias("component"))
