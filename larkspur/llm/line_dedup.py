"""Line deduplication by winnowing over line hashes.

1. Each window of `window` lines of a document selects the place of its least line hash: its fingerprint. Any run of so
   many lines that two documents share has a fingerprint in common, and places between two fingerprints are few.
2. Places that share a fingerprint are joined with the earliest of them and extended both ways, line by line: each
   entry carries the lines of a window on both sides, as far as the next entries go on. Matched lines are runs that
   start earlier elsewhere, and are marked.
3. What no run covers is settled line by line: of equal lines all but the earliest are marked.

A first occurrence is never matched, since a match is always with an earlier place; so each line that also occurs
earlier is marked, and no other. In 2 a task first joins its own places, so of a hot line each task sends one entry; in
3 equal lines of a task meet before they travel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from larkspur.llm.common import NO_ID, PACKED, buckets, by_bucket, cut, in_slices, mix, pack, split_by, trimmed, unpack
from larkspur.llm.repeats import MARKS, SEGMENTS, _at, _document, _merged, _news, _sent, bodies, keyed, lines, rows_of, settle, to_documents, without_marks
from larkspur.llm.windows import window_minima

#: A task joins so many of its fingerprints at a time.
AT_ONCE = 1 << 15
PLACE = ["key", "check", "doc", "tie", "start"]


def line_hashes(units: list[bytes]) -> np.ndarray:
    """128 bits of each line, as two columns."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, units)), ">u8").astype(np.uint64).reshape(-1, 2)


def segments(units: list[bytes], doc: int, tie: int, window: int) -> dict[str, np.ndarray]:
    """The fingerprints of a document, each with the window - 1 lines on both sides, nearest first.

    key, check: the line's hash; sides: the neighbours' hashes, those to the left, then those to the right; left, right:
    how many there are; own, tail: how many of them the entry answers for, on the left those behind the fingerprint
    before, on the right those behind the last. A shared run goes on for less than a window beyond its last common
    fingerprint, so its entries cover it whole.
    """
    h = line_hashes(units)
    n, reach = len(h), window - 1
    at = np.unique(window_minima(h[:, 0], min(window, n)))
    left, right = np.minimum(at, reach), np.minimum(n - 1 - at, reach)
    sides = np.zeros((len(at), 2 * reach, 2), np.uint64)
    for d in range(reach):
        some = left > d
        sides[some, d] = h[at[some] - d - 1]
        some = right > d
        sides[some, reach + d] = h[at[some] + d + 1]
    own, tail = np.diff(np.concatenate([[-1], at])) - 1, np.zeros(len(at), np.int64)
    tail[-1] = right[-1]
    few = {"left": left, "right": right, "own": own, "tail": tail}
    return {"key": h[at, 0], "check": h[at, 1], "doc": np.full(len(at), doc), "tie": np.full(len(at), tie, np.uint32), "start": at.astype(np.uint32), "sides": sides} | {k: v.astype(np.uint8) for k, v in few.items()}


def _joined(parts: list[dict]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def extend(entries: dict[str, np.ndarray], window: int) -> tuple[dict, dict, list[dict]]:
    """The earliest entry of each fingerprint; spans of matched lines; the lines no match covers, but for those of the
    earliest entries, as entries of one line each."""
    order = np.lexsort((entries["start"], entries["tie"], entries["doc"], entries["check"], entries["key"]))
    e = _at(entries, order)
    e = _at(e, _news(*(e[n] for n in PLACE)))  # rows that are one document
    first = _news(e["key"], e["check"])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    reach, met = window - 1, []
    for side, base in (("left", 0), ("right", reach)):
        alive, n = ~first, np.zeros(len(first), np.int64)
        for d in range(reach):
            alive = alive & (e[side] > d) & (e[side][head] > d) & (e["sides"][:, base + d] == e["sides"][head, base + d]).all(axis=1)
            n += alive
        met.append(n)
    spans = {"doc": e["doc"], "tie": e["tie"], "start": (e["start"] - met[0]).astype(np.uint32), "count": (1 + met[0] + met[1]).astype(np.uint32)}
    later = ~first
    return _at(e, first), _at(spans, later), _lone(_at(e, later), met[0][later], met[1][later], window)


def _lone(e: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, window: int, own: bool = False) -> list[dict]:
    """Entries of the lines that e answers for, beyond so many on the left and right; with own its fingerprints too."""
    reach, out = window - 1, []

    def some(at: np.ndarray, h: np.ndarray, start: np.ndarray) -> None:
        n = len(at)
        out.append({"key": h[:, 0], "check": h[:, 1], "doc": e["doc"][at], "tie": e["tie"][at], "start": start.astype(np.uint32), "count": np.ones(n, np.uint32), "hot": np.zeros(n, bool)})

    if own:
        every = np.arange(len(e["key"]))
        some(every, np.stack([e["key"], e["check"]], axis=1), e["start"])
    for d in range(reach):
        at = np.flatnonzero((e["own"] > d) & (left <= d))
        some(at, e["sides"][at, d], e["start"][at] - d - 1)
        at = np.flatnonzero((e["tail"] > d) & (right <= d))
        some(at, e["sides"][at, reach + d], e["start"][at] + d + 1)
    return out


def segment_entries(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed SEGMENTS (the earliest entry of each fingerprint of a task), and MARKS and ENTRIES of its others."""

    def sent(parts: list[dict], spread: int) -> Iterator[tuple[int, int, bytes]]:
        first, spans, lone = extend(_joined(parts), window)
        if len(spans["doc"]):
            yield spread % buckets, MARKS, pack(**_merged(spans))
        yield from _sent(lone, buckets, spread)
        for b, part in split_by((mix(first["key"]) % np.uint64(buckets)).astype(np.int64), first):
            yield b, SEGMENTS, pack(**part)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        from pyspark import TaskContext

        spread, parts, held = TaskContext.get().partitionId() * 31, [], 0
        for batch in batches:
            for doc, body in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist()):
                units = lines(body or b"")
                if units:
                    parts.append(segments(units, NO_ID if doc is None else doc, zlib.crc32(body), window))
                    held += len(parts[-1]["key"])
                if held >= AT_ONCE:
                    yield from sent(parts, spread)
                    spread, parts, held = spread + 1, [], 0
        if parts:
            yield from sent(parts, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(in_slices(rows(batches)))

    return docs.mapInArrow(run, PACKED)


def join_segments(entries: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed MARKS and ENTRIES of SEGMENTS that meet by fingerprint; MARKS and ENTRIES pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        parts = []
        for bucket, kind, blob in rows_of(batches):
            if kind == SEGMENTS:
                parts.append(unpack(blob))
            else:
                yield bucket, kind, blob
        if parts:
            first, spans, lone = extend(_joined(parts), window)
            if len(spans["doc"]):
                yield bucket, MARKS, pack(**_merged(spans))
            none = np.zeros(len(first["key"]), np.int64)
            yield from _sent(lone + _lone(first, none, none, window, own=True), buckets, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(in_slices(rows(batches)))

    return by_bucket(entries, buckets).groupBy("bucket").applyInArrow(run, PACKED)


def _left(body: bytes, units: list[bytes], gone: np.ndarray) -> bytes:
    """The lines that stay, blank ones included, as they were."""
    if not gone.any():
        return body
    going = iter(gone.tolist())
    return b"\n".join([x for x in body.split(b"\n") if not (x.strip() and next(going))])


def line_dedup(docs: DataFrame, window: int = 4, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units (lines with a word), n_removed, removed (line spans), text, and the columns in keep.

    Goes: each line that also occurs earlier (smaller doc_id, or same document and earlier line), alone or in a run.
    Lines are compared without white space at their ends, by 128-bit hashes; blank ones don't count and stay. window
    (2 or more) is the number of lines that selects a fingerprint and doesn't change the result. Null texts stay null
    and have no lines; empty ones stay empty; texts of any length are read whole. A null doc_id is later than all
    others; of rows equal in doc_id and text none repeats the other, and rows that share a doc_id alone are ordered by a
    checksum of the text. Columns neither named nor in keep stay behind, whatever their names; keep may not name a
    column that is made here. A row per row of docs; an empty table gives no rows.
    """
    if not 2 <= window <= 256:
        raise ValueError("window is 2 to 256 lines")
    n = buckets(docs)
    source = keyed(docs, id_col, text_col, keep)
    found = segment_entries(source.select("doc_id", "body"), window, n)
    found = settle(join_segments(found, window, n), n, runs=False).where(F.col("kind") == MARKS)
    return without_marks(bodies(source, n, keep), cut(to_documents(found, n)), n, source, lines, _left, 1, keep)
