"""Packing token sequences: best-two-fit over the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, documents, trimmed

#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _rank long"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """The ids that the tokenizers library gives with a byte-level BPE file and add_special_tokens=False.

    The file's vocabulary and merge order are run by tiktoken's engine, which is four times as fast and gives the same
    ids (tested); a piece's id is its place in the merge order in such files, which is verified here. A text that has
    the literal of an added token is cut there and gets that token's id, as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, added = found["model"], found.get("added_tokens", ())
        special, byte = {t["content"]: t["id"] for t in added}, _byte_of_character()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if i not in special.values()}
        merged = [ranks[bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        if found["pre_tokenizer"].get("type") != "ByteLevel" or found["pre_tokenizer"].get("add_prefix_space") or found["normalizer"] or merged != sorted(merged):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        overlap = any(a != b and any(a[k:] and b.startswith(a[k:]) for k in range(len(a))) for a in special for b in special)
        if overlap or any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that overlap or depend on what is around them")
        self.model = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        return self.model.encode_to_numpy(text, allowed_special="all")


_models: dict[str, Bpe] = {}


def _cut_documents(path: str, end_id: int, room: int):
    """Documents to pieces of at most room tokens. _rank numbers the pieces of one length within a task (_task)."""
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        if path not in _models:
            _models[path] = Bpe(path)
        seen = [0] * (room + 1)
        for batch in batches:
            rows = []
            for doc, body in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist()):
                ids = np.concatenate([_models[path].encode((body or b"").decode("utf-8", "replace")), end]).astype("<u4")
                edges = [0, *range(len(ids) % room or room, len(ids) + 1, room)]  # the first piece takes the odd length
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                    seen[b - a] += 1
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(pieces(batches))

    return run


class Lengths:
    """Counts by length; the largest length in stock at or below a bound, in a step for each length skipped."""

    def __init__(self, counts: dict[int, int], room: int):
        self.count = [0] * (room + 1)
        for k, v in counts.items():
            self.count[k] = v

    def largest(self, bound: int, used: dict[int, int]) -> int:
        """0 if there is none beyond what used takes."""
        while bound > 0 and self.count[bound] <= used.get(bound, 0):
            bound -= 1
        return max(bound, 0)


def _with(used: dict[int, int], *more: int) -> dict[int, int]:
    used = dict(used)
    for x in more:
        used[x] = used.get(x, 0) + 1
    return used


def best_two_fit(counts: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in a bin) for all lengths: bins are filled greedily, largest first.

    Then, in a bin with a gap, the smallest length gives way to the two lengths in stock that fill its place and the
    gap most tightly, if they fill more than it did. A filled bin is repeated while the stock lasts, so the work follows
    the number of different lengths, not of documents.
    """
    stock, out = Lengths(counts, room), []
    while (top := stock.largest(room, {})) > 0:
        bin_, gap = [top], room - top
        used = _with({}, top)
        while x := stock.largest(gap, used):
            bin_.append(x)
            used = _with(used, x)
            gap -= x
        if gap and len(bin_) > 1:
            small = bin_[-1]
            left = _with({}, *bin_[:-1])
            best, pair = small, None
            space = gap + small
            a = stock.largest(space - 1, left)
            while a and 2 * a >= best and best < space:
                b = stock.largest(min(a, space - a), _with(left, a))
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                a = stock.largest(a - 1, left)
            if pair:
                bin_ = [*bin_[:-1], *pair]
                used = _with({}, *bin_)
        times = min(stock.count[x] // n for x, n in used.items())
        for x, n in used.items():
            stock.count[x] -= times * n
        out.append((times, tuple(bin_)))
    return out


def _places(bins: list[tuple[int, tuple[int, ...]]], room: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of equal places, the run's first bin, the offset in the bin."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken, number = [0] * (room + 1), 0
    for times, lengths in bins:
        offset = 0
        for x in lengths:
            found.setdefault(x, []).append((taken[x], number, offset))
            taken[x] += times
            offset += x
        number += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*v)) for x, v in found.items()}


def _place(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_number"].to_numpy()
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, number, offset = places[int(x)]
                run_ = np.searchsorted(first, rank[at], "right") - 1
                bins[at] = number[run_] + rank[at] - first[run_]
                offsets[at] = offset[run_]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, room: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents packed in sequences of at most room tokens.

    A document is its ids and end_id; null and empty texts are end_id alone. Only documents of over room tokens are
    cut, in pieces of room tokens after a first piece that may be shorter. Repeated rows are packed each on its own;
    null doc_ids stay null; other columns stay behind, whatever their names; an empty table gives no rows. Pieces are written once, since their ranks must not change afterwards. The
    driver sees the histogram of lengths (room rows at most) and packs that; a piece's place follows from its rank
    among the pieces of its length, counted by task and summed over the tasks before.
    """
    pieces = cut(documents(docs, id_col, text_col).mapInArrow(_cut_documents(tokenizer_path, end_id, room), PIECES))
    counted = cut(pieces.groupBy("_task", "length").agg(F.count("*").alias("_count")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_count").alias("n")).collect()}  # at most room rows
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_task", "length", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["_task", "length"]).withColumn("_number", F.col("_before") + F.col("_rank"))
    return ranked.mapInArrow(_place(_places(best_two_fit(counts, room), room)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
