"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import documents, few_at_once, trim, trimmed

#: Words and shapes hash to SLOTS rows each; vectors have WIDTH numbers; the matrix travels in BLOCKS.
SLOTS, WIDTH, BLOCKS, SPAN = 1 << 14, 32, 16, 2
#: The network learns from so many labelled rows at most, those of least hash.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: How much the parts of a pooled vector weigh, each as a whole: words, shapes, repeats, size.
WEIGHTS = np.concatenate([np.full(WIDTH, 0.5 * WIDTH**-0.5), np.full(WIDTH, 2.0 * WIDTH**-0.5), [2.0, 0.5]])
#: Shapes whose slots are kept.
SHAPES = 50_000
#: Texts whose words are held at once.
TEXTS = 100
_KIND = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i > 127 else 48 if 48 <= i <= 57 else i for i in range(256))
_SAME = re.compile(rb"(.)\1+", re.S)
_shapes: dict[bytes, int] = {}


def _shape(kinds: bytes) -> int:
    """Slot of a shape: letters A and a, digits 0, others as they are, runs shortened to two."""
    if len(_shapes) >= SHAPES:
        _shapes.clear()
    found = _shapes[kinds] = crc32(_SAME.sub(rb"\1\1", kinds)) % SLOTS
    return found


def _tokens(bodies: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of all words (lower-cased) of the texts in a row, slots of their shapes, and the number of words of each text."""
    split = [b.lower().split() for b in bodies]
    sizes = np.array([len(x) for x in split], np.int64)
    words = np.fromiter(map(crc32, itertools.chain.from_iterable(split)), np.int64, sizes.sum()) % SLOTS
    kinds = itertools.chain.from_iterable(b.translate(_KIND).split() for b in bodies)
    shapes = np.fromiter((s if (s := _shapes.get(k)) is not None else _shape(k) for k in kinds), np.int64, sizes.sum())
    return [words, shapes], sizes


def _index_vectors() -> list[tuple[np.ndarray, np.ndarray]]:
    """The random index vectors of the slots of words, and of shapes: two places each that hold 1 or -1."""
    draw = np.random.default_rng(20240229)
    return [(draw.integers(0, WIDTH, (2, SLOTS)), draw.choice([-1.0, 1.0], (2, SLOTS))) for _ in range(2)]


def _add_contexts(totals: np.ndarray, bodies: list[bytes], index_vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds to each slot's vector the index vectors of its neighbours, SPAN words to either side."""
    streams, sizes = _tokens(bodies)
    text = np.repeat(np.arange(len(sizes)), sizes)
    together = [text[step:] == text[:-step] for step in range(1, SPAN + 1)]
    for total, stream, (place, sign) in zip(totals, streams, index_vectors):
        row, at, weight = stream * WIDTH, [], []
        for p, s in zip(place, sign):
            p, s = p[stream], s[stream]
            for step, same in enumerate(together, 1):
                at += [(row[:-step] + p[step:])[same], (row[step:] + p[:-step])[same]]
                weight += [s[step:][same], s[:-step][same]]
        total += np.bincount(np.concatenate(at), np.concatenate(weight), total.size)


def word_vectors(plain: DataFrame) -> np.ndarray:
    """Vectors of all slots, from all rows. A task sends its sums once, in BLOCKS rows; the whole is 4 MB at any size.

    The sums are of ones and minus ones, so they are whole numbers, and the order in which they meet changes nothing.
    """
    each = 2 * SLOTS * WIDTH // BLOCKS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals, index_vectors = np.zeros((2, SLOTS * WIDTH)), _index_vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * TEXTS):
                _add_contexts(totals, [b or b"" for b in batch["body"].slice(at, 4 * TEXTS).to_pylist()], index_vectors)
        total = totals.reshape(-1)
        blobs = [total[i * each : (i + 1) * each].astype("<i8").tobytes() for i in range(BLOCKS)]
        few = TaskContext.get().partitionId() // 64
        yield pa.RecordBatch.from_arrays([pa.array([few] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], names=["few", "block", "sums"])

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(sums(batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, few, block = np.zeros(each, np.int64), 0, 0
        for batch in batches:
            few, block = batch["few"][0].as_py(), batch["block"][0].as_py()
            for blob in batch["sums"].to_pylist():
                total += np.frombuffer(blob, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([few], pa.int32()), pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["few", "block", "sums"])

    kind = "few int, block int, sums binary"
    found = plain.mapInArrow(lean, kind).groupBy("few", "block").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind).collect()  # BLOCKS rows
    whole = np.zeros((BLOCKS, each))
    for row in found:
        whole[row["block"]] = np.frombuffer(row["sums"], "<i8")
    whole = whole.reshape(2 * SLOTS, WIDTH)
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)
    return (whole - whole.mean(axis=0)).astype(np.float32)


def pooled(bodies: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: mean vectors of words and shapes, the share of words like the one before, log size."""
    streams, sizes = _tokens(bodies)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), 2 * WIDTH + 2), np.float32)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    if len(full):
        for k, stream in enumerate(streams):
            out[full, k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(vectors[stream + k * SLOTS], starts, axis=0) / sizes[full, None]
        again = np.concatenate([[False], (streams[0][1:] == streams[0][:-1]) & (text[1:] == text[:-1])])
        out[full, -2] = np.add.reduceat(again.astype(np.float32), starts) / sizes[full]
    out[:, -1] = np.log1p(sizes)
    return out


class Network:
    """Two layers with numpy, Adam, and a temperature fitted on rows left out of the training."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | float = 1.0):
        self.mean, self.std = x.mean(axis=0), (x.std(axis=0) + 1e-3) / weights
        x, draw = (x - self.mean) / self.std, np.random.default_rng(7)
        spare = np.arange(len(y)) % 5 == 4
        n = x.shape[1]
        self.parts = [draw.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._fit(x[~spare], y[~spare], draw)
        self._calibrate(x[spare], y[spare])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.parts[0] + self.parts[1]) @ self.parts[2] + self.parts[3][0]

    def _fit(self, x: np.ndarray, y: np.ndarray, draw) -> None:
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        turn = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(y))
            for at in range(0, len(y), 256):
                a, b = x[order[at : at + 256]], y[order[at : at + 256]]
                hidden = np.tanh(a @ self.parts[0] + self.parts[1])
                error = (1 / (1 + np.exp(-(hidden @ self.parts[2] + self.parts[3][0]))) - b) / len(b)
                back = np.outer(error, self.parts[2]) * (1 - hidden**2)
                slopes = [a.T @ back + DECAY * self.parts[0], back.sum(axis=0), hidden.T @ error + DECAY * self.parts[2], error.sum(keepdims=True)]
                turn += 1
                for p, g, m, v in zip(self.parts, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if not len(y):
            return
        logits, sign = self._logits(x), 2 * y - 1
        tried = np.geomspace(0.25, 8, 61)
        self.temperature = float(tried[np.argmin([np.logaddexp(0, -sign * logits / t).mean() for t in tried])])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.std) / self.temperature, -500, 500)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class QualityModel:
    """Word vectors of a corpus and the network fitted on its labelled rows; flat stands in where no network can be fitted."""

    def __init__(self, vectors: np.ndarray, network: Network | None, flat: float):
        self.vectors, self.network, self.flat = vectors, network, flat

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        if not self.network:
            return np.full(len(bodies), self.flat)
        return self.network.score(pooled(bodies, self.vectors).astype(float))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """A model whose word vectors come from all rows of docs, and whose network learns from at most sample labelled rows.

    Rows that are held out (crc32 of doc_id as text, modulo 5, is 0) are never learnt from; of the others those of least
    hash are, and of rows that share a doc_id one. Null labels and labels of unknown documents don't count; of several
    labels of a document the largest does.
    """
    plain = documents(docs, id_col, text_col)
    vectors = word_vectors(plain)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("_label"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pooled([b or b"" for b in batch["body"].to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_label"], pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "_label", "pooled"])

    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # 4 MB
    learnt = plain.join(F.broadcast(known), "doc_id").mapInArrow(pool, "doc_id long, _label double, pooled binary")
    learnt = learnt.groupBy("doc_id").agg(F.min("_label").alias("_label"), F.min("pooled").alias("pooled"))  # however often a doc_id occurs
    learnt = learnt.toPandas().sort_values("doc_id")  # at most sample rows of 264 bytes
    y = learnt["_label"].to_numpy(float)
    network = Network(np.stack([np.frombuffer(b, np.float32) for b in learnt["pooled"]]).astype(float), y, WEIGHTS) if len(set(y)) > 1 else None
    flat = float(y.mean()) if len(y) else 0.5
    del learnt, y
    trim()  # the driver lives on
    return QualityModel(vectors, network, flat)


def scored(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with its score as one more column, which replaces one of that name. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            bodies = [b or b"" for b in some]
            yield pd.Series(np.concatenate([sent.value.scores(bodies[i : i + TEXTS]) for i in range(0, len(bodies), TEXTS)]) if bodies else [], dtype=float)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(rows(texts))

    few_at_once(docs.sparkSession)
    return docs.withColumn(score_col, F.pandas_udf(run, "double")(F.col(text_col).cast("string").cast("binary")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs: see quality_model().

    Without labels of both classes the score is their mean, or 0.5 without any. Null texts score as empty ones: their
    pooled vector is zero. Null doc_ids aren't held out and have no label. Repeated rows and equal texts score alike,
    each row on its own; texts of any length are read whole. Columns other than the two named stay behind, in labels
    too, whatever their names. An empty table gives no rows. Texts are read for the vectors, for the sample and for the
    scores, and never shuffled.
    """
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), quality_model(docs, labels, id_col, text_col, label_col, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
