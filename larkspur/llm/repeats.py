"""Runs of words that occur earlier in the corpus: winnowed fingerprints, settled by bucket.

A window is `window` consecutive units of one document. Each window selects the least hash among its runs of `gram`
units (winnowing); a block is a stretch of windows that select the same place. Equal windows select equal grams, so
they lie in blocks of one fingerprint:

1. Blocks are keyed by fingerprint, with a hash of the whole block's bytes as the check. Of equal blocks all but the
   earliest are marked: each of their windows starts earlier elsewhere.
2. Where a fingerprint has different blocks, equal windows may lie in unequal blocks: there the earliest of each
   block's copies is extended to all its windows, and these are settled in the same way, one by one.

The key is a polynomial over the units' hashes; the check is another hash, with another seed, of the joined bytes, so
units whose hashes collide don't collide in both.

So the result is that of comparing all windows, while about 2 / (window - gram + 2) entries a unit travel, each bucket
as one packed row. Equal entries of a task meet before they travel, so a passage in a third of all documents leaves a
task as one entry. A fingerprint with many different blocks in a task is hot: the blocks go to buckets dealt by block,
a notice goes to the fingerprint's own bucket, and all blocks of the fingerprint are taken as step 2 takes them.

Documents are known by doc_id and a checksum of the text, and ordered by these. Rows equal in both are one document:
none of them repeats the other, and all get its marks. Texts meet their marks in a shuffle sorted so that a bucket's
marks come first: its texts then pass one packed row at a time and are never held together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from larkspur.llm.common import NO_ID, PACKED, PACKED_ARROW, by_bucket, documents, in_slices, mix, pack, packed_batch, split_by, trimmed, unpack, unpack_all
from larkspur.llm.windows import window_hashes, window_minima

ENTRIES, MARKS, MIXED, RUN, BODIES, SEGMENTS = range(6)
FIELDS = ["key", "check", "doc", "tie", "start", "count", "hot"]
SPANS = ["doc", "tie", "start", "count"]
KINDS = {"key": np.uint64, "check": np.uint64, "doc": np.int64, "tie": np.uint32, "start": np.uint32, "count": np.uint32, "hot": np.bool_}
CHECK_SEED = 0x5EED
#: A task settles so many entries at a time; a fingerprint with so many different blocks among them is hot.
AT_ONCE, HOT = 1 << 17, 64
#: Bytes of text that a task deals to buckets at a time.
TEXT_AT_ONCE = 12 << 20

#: Bytes of an entry in a packed row.
ENTRY_SIZE = sum(np.dtype(KINDS[n]).itemsize for n in FIELDS)

Tokenise = Callable[[bytes], list[bytes]]


def words(body: bytes) -> list[bytes]:
    """Units of [^\\x20\\x09-\\x0D]."""
    return body.split()


def lines(body: bytes) -> list[bytes]:
    """Lines with a word, without white space at their ends."""
    return [x for x in map(bytes.strip, body.split(b"\n")) if x]


def hashed(units: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, units), np.uint64, len(units))


def joined_units(units: list[bytes], joiner: bytes) -> tuple[bytes, list[int], list[int]]:
    """The joined bytes, and where each unit starts and stops in them. No unit has the joiner in it."""
    stop = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + len(joiner)) - len(joiner)
    start = np.concatenate([[0], stop[:-1] + len(joiner)]) if len(units) else stop
    return joiner.join(units), start.tolist(), stop.tolist()


def checks(units: list[bytes], start: np.ndarray, stop: np.ndarray, joiner: bytes = b" ") -> np.ndarray:
    """A hash of the bytes of units[start:stop] for each pair: independent of the units' own hashes."""
    body, a, b = joined_units(units, joiner)
    return np.fromiter((xxh3_64_intdigest(body[a[i] : b[j - 1]], CHECK_SEED) for i, j in zip(start.tolist(), stop.tolist())), np.uint64, len(start))


def blocks(units: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """key, check, start, count of each block of a document."""
    n = len(units) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = window_hashes(hashed(units), gram)
    place = window_minima(grams, window - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(start, n))
    return grams[place[start]], checks(units, start, start + count - 1 + window), start, count


def _joined(parts: list[dict[str, np.ndarray]], names: list[str]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]).astype(KINDS[n], copy=False) if parts else np.zeros(0, KINDS[n]) for n in names}


def _entry_blob(entries: dict[str, np.ndarray]) -> bytes:
    """Entries as their columns' bytes, nothing more: a task may send but a few to each of many buckets."""
    return b"".join([entries[n].astype(KINDS[n], copy=False).tobytes() for n in FIELDS])


def _entries_of(blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(blob) // ENTRY_SIZE, 0, {}
    for name in FIELDS:
        out[name] = np.frombuffer(blob, KINDS[name], n, at)
        at += out[name].nbytes
    return out


def _at(arrays: dict[str, np.ndarray], where, names: list[str] | None = None) -> dict[str, np.ndarray]:
    return {n: arrays[n][where] for n in names or arrays}


def _news(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _merged(spans: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring and overlapping spans of a document as one."""
    s = _at(spans, np.lexsort((spans["start"], spans["tie"], spans["doc"])))
    first = _news(s["doc"], s["tie"])
    first[1:] |= s["start"][1:] > s["start"][:-1] + s["count"][:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return s
    return _at(s, at, ["doc", "tie", "start"]) | {"count": (np.maximum.reduceat(s["start"] + s["count"], at) - s["start"][at]).astype(np.uint32)}


def _settle(entries: dict[str, np.ndarray], old: np.ndarray) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """The sorted entries and old; which is the first of its (key, check); which repeats a first that is another place."""
    order = np.lexsort((entries["start"], entries["tie"], entries["doc"], ~old, entries["check"], entries["key"]))
    e, old = _at(entries, order), old[order]
    first = _news(e["key"], e["check"])
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, int)
    same = (e["doc"] == e["doc"][head]) & (e["tie"] == e["tie"][head]) & (e["start"] == e["start"][head])
    return e, old, first, ~first & ~same & ~old & (e["count"] > 0)


def _sent(parts: list[dict], buckets: int, spread: int) -> Iterator[tuple[int, int, bytes]]:
    """What a task sends of its entries: marks of those that repeat another of them, and the others by bucket."""
    entries = _joined(parts, FIELDS)
    e, _, first, repeats = _settle(entries, np.zeros(len(entries["key"]), bool))
    if repeats.any():
        yield spread % buckets, MARKS, pack(**_merged(_at(e, repeats, SPANS)))
    e = _at(e, first)
    new_key = _news(e["key"])
    at = np.flatnonzero(new_key)
    many = np.diff(np.append(at, len(new_key))) >= HOT
    e["hot"] = np.repeat(many, np.diff(np.append(at, len(new_key)))) if len(at) else e["hot"]
    bucket = np.where(e["hot"], mix(e["key"] ^ mix(e["check"])), mix(e["key"])) % np.uint64(buckets)
    if many.any():
        notice = _at(e, at[many]) | {"check": np.zeros(many.sum(), np.uint64), "count": np.zeros(many.sum(), np.uint32)}
        bucket = np.concatenate([bucket, mix(notice["key"]) % np.uint64(buckets)])
        e = {n: np.concatenate([e[n], notice[n]]) for n in e}
    order = np.lexsort((e["start"], e["tie"], e["doc"]))  # so that a bucket's documents ascend, and pack well
    for b, part in split_by(bucket[order].astype(np.int64), _at(e, order)):
        yield b, ENTRIES, _entry_blob(part)


def _document(doc, tie, key, check, start, count) -> dict[str, np.ndarray]:
    n = len(key)
    return {"key": key, "check": check, "doc": np.full(n, doc), "tie": np.full(n, tie, np.uint32), "start": start, "count": count, "hot": np.zeros(n, bool)}


def block_entries(docs: DataFrame, tokenise: Tokenise, window: int, gram: int, buckets: int) -> DataFrame:
    """Packed entries (by bucket) and marks of documents()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        from pyspark import TaskContext

        spread, parts, held = TaskContext.get().partitionId() * 31, [], 0
        for batch in batches:
            for doc, body in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist()):
                found = blocks(tokenise(body or b""), window, gram)
                if len(found[0]):
                    parts.append(_document(NO_ID if doc is None else doc, zlib.crc32(body), *found))
                    held += len(found[0])
                if held >= AT_ONCE:
                    yield from _sent(parts, buckets, spread)
                    spread, parts, held = spread + 1, [], 0
        yield from _sent(parts, buckets, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(in_slices(rows(batches)))

    return docs.mapInArrow(run, PACKED)


def settled(blobs: Iterator[tuple[int, int, bytes]], runs: bool = True) -> list[tuple[int, int, bytes]]:
    """Packed MARKS, MIXED and, with runs, RUN rows of one bucket's ENTRIES, RUN (history, earlier than all entries) and MARKS."""
    parts, out, bucket = {ENTRIES: [], RUN: []}, [], 0
    for bucket, kind, blob in blobs:
        if kind == MARKS:
            out.append((bucket, MARKS, blob))
        else:
            parts[kind].append(_entries_of(blob))
    new, old = _joined(parts[ENTRIES], FIELDS), _joined(parts[RUN], FIELDS)
    e, was, first, repeats = _settle({n: np.concatenate([old[n], new[n]]) for n in FIELDS}, np.arange(len(old["key"]) + len(new["key"])) < len(old["key"]))
    if repeats.any():
        out.append((bucket, MARKS, pack(**_merged(_at(e, repeats, SPANS)))))
    e, was = _at(e, first), was[first]
    if len(was):
        group = np.cumsum(_news(e["key"])) - 1
        several, fresh, hot = np.bincount(group) > 1, np.bincount(group, ~was) > 0, np.bincount(group, e["hot"]) > 0
        mixed = ((several | hot) & fresh)[group] & (e["count"] > 0)
        if mixed.any():
            out.append((bucket, MIXED, pack(**_at(e, mixed, SPANS))))
        if runs and not was.all():
            out.append((bucket, RUN, _entry_blob(_at(e, ~was))))
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows, one blob at a time."""
    for batch in batches:
        for bucket, kind, blob in zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), batch["blob"]):
            yield bucket, kind, blob.as_py()


def settle(entries: DataFrame, n_buckets: int, runs: bool = True) -> DataFrame:
    """settled() of each of n_buckets buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed_batch(settled(rows_of(batches), runs))

    return by_bucket(entries, n_buckets).groupBy("bucket").applyInArrow(run, PACKED)


def _home(doc: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) ^ mix(tie.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def to_documents(spans: DataFrame, buckets: int) -> DataFrame:
    """Packed MARKS or MIXED rows, dealt to the buckets of their documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            for kind in (MARKS, MIXED):
                found = unpack_all([b for k, b in zip(batch["kind"].to_pylist(), batch["blob"].to_pylist()) if k == kind], SPANS)
                if found:
                    for b, part in split_by(_home(found["doc"], found["tie"], buckets), found):
                        yield b, kind, pack(**part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(in_slices(rows(batches)))

    return spans.mapInArrow(run, PACKED)


def bodies(docs: DataFrame, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packed rows of documents (doc_id, body and the columns in keep), dealt to buckets."""

    def dealt(held: list[dict]) -> Iterator[tuple[int, int, bytes]]:
        rows = {n: [x for part in held for x in part[n]] for n in ("doc_id", "body", *keep)}
        doc = np.array([NO_ID if x is None else x for x in rows["doc_id"]], np.int64)
        tie = np.array([zlib.crc32(x or b"") for x in rows["body"]], np.uint32)
        for b, part in split_by(_home(doc, tie, buckets), {"at": np.arange(len(doc))}):
            at = part["at"].tolist()
            yield b, BODIES, pack(doc=doc[at], tie=tie[at], **{f"c_{n}": [rows[n][i] for i in at] for n in rows})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held, size = [], 0
        for batch in batches:
            held.append({n: batch[n].to_pylist() for n in ("doc_id", "body", *keep)})
            size += batch.nbytes
            if size >= TEXT_AT_ONCE:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(in_slices(rows(batches)))

    return docs.mapInArrow(run, PACKED)


def _spans_of(parts: list[dict], kinds=SPANS) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Start and count of the spans of each document."""
    s = _joined(parts, list(kinds))
    if not len(s["doc"]):
        return {}
    s = _at(s, np.lexsort((s["start"], s["tie"], s["doc"])))
    at = np.flatnonzero(_news(s["doc"], s["tie"]))
    return {(int(s["doc"][a]), int(s["tie"][a])): (s["start"][a:b].astype(np.int64), s["count"][a:b].astype(np.int64)) for a, b in zip(at, np.append(at[1:], len(s["doc"])))}


def meeting(texts: DataFrame, spans: DataFrame, n_buckets: int) -> DataFrame:
    """Packed texts and spans by bucket, a bucket's spans first."""
    return by_bucket(texts.unionByName(spans), n_buckets).sortWithinPartitions("bucket", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """Each packed row of texts with the spans of its bucket, as meeting() brings them."""
    now, parts, spans = None, [], None
    for bucket, kind, blob in rows_of(batches):
        if bucket != now:
            now, parts, spans = bucket, [], None
        if kind != BODIES:
            parts.append(unpack(blob))
        else:
            if spans is None:
                spans, parts = _spans_of(parts), []
            yield unpack(blob), spans


def window_entries(texts: DataFrame, mixed: DataFrame, tokenise: Tokenise, window: int, buckets: int) -> DataFrame:
    """Packed entries of all windows in mixed blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        parts, held, spread = [], 0, 0
        for part, spans in _met(batches):
            for doc, tie, body in zip(part["doc"].tolist(), part["tie"].tolist(), part["c_body"]) if spans else ():
                if (doc, tie) not in spans:
                    continue
                start, count = spans.pop((doc, tie))  # of rows that are one document the first is enough
                units = tokenise(body or b"")
                edge = np.zeros(len(units) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + count, -1)
                at = np.flatnonzero(np.cumsum(edge) > 0)
                parts.append(_document(doc, tie, window_hashes(hashed(units), window)[at], checks(units, at, at + window), at, np.ones(len(at), np.uint32)))
                held, spread = held + len(at), spread + doc
                if held >= AT_ONCE:
                    yield from _sent(parts, buckets, spread)
                    parts, held = [], 0
        if parts:
            yield from _sent(parts, buckets, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(in_slices(rows(batches)))

    return meeting(texts, mixed, buckets).mapInArrow(run, PACKED)


def removed_units(start: np.ndarray, count: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n units are covered by the marked windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + count - 1 + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def without_marks(texts: DataFrame, marks: DataFrame, n_buckets: int, source: DataFrame, tokenise: Tokenise, rebuild: Callable[[bytes, list[bytes], np.ndarray], bytes], window: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_units, n_removed, removed (spans of units: start, stop), text, and the columns in keep.

    rebuild makes the new text of a document from the old one, its units and which of them go; texts without a
    removed unit pass through it too. Null texts stay null.
    """
    kept = [source.schema[n] for n in keep]
    schema = StructType.fromDDL("doc_id long, n_units long, n_removed long, removed array<struct<start:long,stop:long>>, text string")
    schema = StructType([*schema.fields, *kept])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), *[to_arrow_type(f.dataType) for f in kept]]
    names = [f.name for f in schema]

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, spans in _met(batches):
            out = []
            for i, (doc, tie, body) in enumerate(zip(part["doc"].tolist(), part["tie"].tolist(), part["c_body"])):
                units = tokenise(body or b"")
                gone = removed_units(*spans.get((doc, tie), none), window, len(units))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans_ = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                text = None if body is None else rebuild(body, units, gone).decode("utf-8", "replace")
                out.append((part["c_doc_id"][i], len(units), int(gone.sum()), spans_, text, *[part[f"c_{n}"][i] for n in keep]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(done(batches))

    return meeting(texts, marks, n_buckets).mapInArrow(run, schema)


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents() with the columns in keep."""
    if clash := set(keep) & {"doc_id", "body", "text", "n_units", "n_removed", "removed"}:
        raise ValueError(f"keep names columns that are made here: {sorted(clash)}")
    plain = documents(docs, id_col, text_col)
    return plain if not keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"), *keep)
