"""Substring deduplication with a log-structured index of fingerprints."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import PACKED, buckets, cut, own_path, packed_batch, remove_path
from larkspur.llm.repeats import FIELDS, MARKS, MIXED, RUN, _at, _entries_of, _entry_blob, _joined, block_entries, bodies, keyed, settle, settled, to_documents, window_entries, without_marks, words

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TABLE = f"{PACKED}, run int"


def _rows(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    return zip(*(table[c].to_pylist() for c in ("bucket", "kind", "blob")))


class FingerprintIndex:
    """Sorted immutable runs of the window fingerprints of all batches so far, in a folder that all executors share.

    The runs are files of a table bucketed by `bucket`: add() merge-joins a batch with them bucket by bucket, so that
    the batch alone is shuffled, and appends what is new as one more run. Beyond most_runs runs, compact() merges them
    into one sorted run, without a shuffle. A hit holds if a hash of the whole block's bytes agrees.

    An index outlives its session: made again with the same path, it goes on where it was (its settings are read from
    there). Batches must come in the order of their documents: doc_ids of a later one are greater, and null doc_ids
    are in the last. A lost executor costs a task; a job that fails as a whole leaves the runs before it as they were.
    """

    def __init__(self, spark: SparkSession, path: str, window: int, gram: int, n_buckets: int, most_runs: int = 2):
        self.spark, self.path = spark, path
        self.state = self._read_state() or {"version": 0, "window": window, "gram": gram, "buckets": n_buckets, "files": max(1, n_buckets // 4), "most_runs": most_runs, "runs": [], "made": 0, "folder": 0, "compactions": 0}
        self.table = None
        if self.state["runs"]:
            self._open()

    @property
    def runs(self) -> list[int]:
        return self.state["runs"]

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read_state(self) -> dict | None:
        """The last state that was written whole."""
        files, at = self._hadoop(f"{self.path}/state")
        if not files.exists(at):
            return None
        done = [int(f.getPath().getName()) for f in files.listStatus(at) if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return json.loads(self.spark.read.text(f"{self.path}/state/{max(done)}").first()[0]) if done else None

    def _write_state(self, **changes) -> None:
        before = self.state["version"]
        self.state |= changes | {"version": before + 1}
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.path}/state/{before + 1}")
        if before:
            remove_path(self.spark, f"{self.path}/state/{before}")

    def _folder(self, number: int) -> str:
        return f"{self.path}/runs-{number}"

    def _open(self) -> None:
        """The table of the present runs, under a name of its own."""
        self.table = f"larkspur_runs_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.table} ({TABLE}) USING parquet CLUSTERED BY (bucket) SORTED BY (kind) INTO {self.state['files']} BUCKETS LOCATION '{self._folder(self.state['folder'])}'")

    def _write(self, rows: DataFrame, table: str, number: int, folder: int) -> None:
        writer = rows.withColumn("run", F.lit(number)).write.format("parquet").mode("append").option("compression", "zstd")
        writer.bucketBy(self.state["files"], "bucket").sortBy("kind").option("path", self._folder(folder)).saveAsTable(table)

    def _read(self, *kinds: int) -> DataFrame:
        """Rows of the index's own runs: what a failed job left behind isn't among them."""
        return self.spark.table(self.table).where(F.col("kind").isin(*kinds) & F.col("run").isin(*self.runs)).drop("run")

    def add(self, docs: DataFrame) -> DataFrame:
        """Packed MARKS and MIXED rows of a batch of documents, all of them later than those before."""
        entries = block_entries(docs, words, self.state["window"], self.state["gram"], self.state["buckets"])
        number = self.state["made"] + 1
        self._write_state(made=number)  # a number is used once, even if the job fails
        if self.table is None:
            self._open()
        if self.runs:
            merge = lambda new, old: pa.Table.from_batches([packed_batch(settled([*_rows(old), *_rows(new)]))])
            found = entries.groupBy("bucket").cogroup(self._read(RUN).groupBy("bucket")).applyInArrow(merge, PACKED)
        else:
            found = settle(entries, self.state["buckets"])
        self._write(found, self.table, number, self.state["folder"])
        self._write_state(runs=[*self.runs, number])
        out = cut(self.spark.table(self.table).where(F.col("kind").isin(MARKS, MIXED) & (F.col("run") == number)).drop("run"))
        if len(self.runs) > self.state["most_runs"]:
            self.compact()
        return out

    def compact(self) -> None:
        """All runs as one, sorted by key and check, in a folder of its own; then the old ones go."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, bucket = [], 0
            for batch in batches:
                parts += [_entries_of(b) for b in batch["blob"].to_pylist()]
                bucket = batch["bucket"][0].as_py()
            whole = _joined(parts, FIELDS)
            yield packed_batch([(bucket, RUN, _entry_blob(_at(whole, np.lexsort((whole["check"], whole["key"])))))])

        number, old, folder = self.state["made"] + 1, self.table, self.state["folder"] + 1
        remove_path(self.spark, self._folder(folder))  # a failed compaction may have left it
        new = f"larkspur_runs_{uuid.uuid4().hex}"
        self._write(self._read(RUN).groupBy("bucket").applyInArrow(merge, PACKED), new, number, folder)
        self._write_state(runs=[number], made=number, folder=folder, compactions=self.state["compactions"] + 1)
        self.table = new
        self.spark.sql(f"DROP TABLE {old}")
        remove_path(self.spark, self._folder(folder - 1))

    def remove(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE {self.table}")
            self.table = None
        remove_path(self.spark, self.path)


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs in n ranges of doc_id of about equal size; nulls are in the last."""
    edges = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000)).first()[0] or [])) if n > 1 else []
    out, low = [], None
    for high in [*edges, None]:
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        out.append(docs.where(inside & (F.col("doc_id") <= high)) if high is not None else docs.where(inside | F.col("doc_id").isNull()))
        low = high
    return out


def _spaced(body: bytes, units: list[bytes], gone: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    return b" ".join([u for u, g in zip(units, gone.tolist()) if not g]) if gone.any() else b" ".join(units)


def _as_it_was(body: bytes, units: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the removed words and the white space behind each of them."""
    if not gone.any():
        return body
    out, at = [], 0
    places = [m.span() for m in _WORD.finditer(body)]
    ends = [a for a, _ in places[1:]] + [len(body)]
    for (a, _), end, g in zip(places, ends, gone.tolist()):
        if g:
            out.append(body[at:a])
            at = end
    return b"".join([*out, body[at:]])


def substring_dedup(
    docs: DataFrame,
    window: int = 20,
    gram: int = 7,
    batches: int = 4,
    spaced: bool = False,
    keep: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    index: FingerprintIndex | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """doc_id, n_units (words), n_removed, removed (word spans), text, and the columns in keep, a row per row of docs.

    Goes: each word covered by a window of `window` words whose sequence also starts earlier (smaller doc_id, or same
    document and earlier start), judged on the input. Documents go through the index in `batches` ranges of doc_id.
    text is the old text without those words and the white space behind each, or with spaced the kept words joined by
    one space. Null texts have no words and stay null; empty ones stay empty; texts of any length are read whole. Null
    doc_ids are later than all others. Of rows equal in doc_id and text none repeats the other; rows that share a
    doc_id alone are ordered by a checksum of the text. Columns neither named nor in keep stay behind, whatever their
    names; keep may not name a column that is made here. An empty table gives no rows.

    With an index, docs are compared with all that it has too, are added to it, and it is kept. history must then have
    the documents it has (id_col and text_col, with ids, all smaller than those of docs): where a fingerprint has
    different surroundings, their words are read again. The rows are those that docs would have beside history in one
    call. Without an index, one is made for the call and removed after it.
    """
    spark, n = docs.sparkSession, buckets(docs)
    own = index is None
    index = index or FingerprintIndex(spark, own_path(spark, "fingerprints"), window, gram, n)
    if (index.state["window"], index.state["gram"]) != (window, gram):
        raise ValueError(f"the index has windows of {index.state['window']} and grams of {index.state['gram']} words")
    if index.runs and history is None:
        raise ValueError("an index that has documents needs them as history")
    source = keyed(docs, id_col, text_col, keep)
    plain = source.select("doc_id", "body")
    every = plain if history is None else plain.unionByName(keyed(history, id_col, text_col))
    found = None
    for batch in _batches(plain, batches) if batches > 1 else [plain]:
        some = index.add(batch)
        found = some if found is None else found.unionByName(some)
    dealt = cut(to_documents(found, n))
    if own:
        index.remove()
    mixed, marks = dealt.where(F.col("kind") == MIXED), dealt.where(F.col("kind") == MARKS)
    more = settle(window_entries(bodies(every, n), mixed, words, window, n), n, runs=False).where(F.col("kind") == MARKS)
    marks = marks.unionByName(cut(to_documents(more, n)))
    return without_marks(bodies(source, n, keep), marks, n, source, words, _spaced if spaced else _as_it_was, window, keep)
