"""Exact SentencePiece (BPE type) encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from larkspur.llm.common import documents

MARK = "▁"
#: Words and parts of words kept by a worker; a full cache starts anew.
CACHED = 1_000_000
#: From here on merging uses a heap.
LONG = 64


class PieceCodec:
    """Encodes and decodes as the library does with a BPE model that has byte fallback and an identity normaliser.

    A token sequence is the encoding of its text if each two neighbours are the encoding of their joined text.
    encode_part() takes the longest piece at each place, from an Aho-Corasick automaton of all pieces, and checks it with
    the token before by re-merging the two, once for each pair of tokens. When no piece fits, it marks the place
    in a bitfield of failed positions, drops the token before and tries its next shorter match.

    No piece spans two characters that aren't neighbours in any piece, so texts are cut there, above all before each
    space mark; parts recur and are kept. Runs of several marks are ranked alike in the model, and are merged plainly.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.raw = [self.pieces[i].encode() for i in range(n)]
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        for i in range(n):
            if model.is_control(i):
                self.raw[i] = b""
        self.unknown = model.unk_id()
        if alone := {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError(f"characters of pieces of {path} that are no pieces: {sorted(alone)[:5]}")
        self.reachable = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}  # no text merges to the others
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self.reachable:
            self.matcher.add_word(piece)
        self.matcher.make_automaton()
        #: By id: characters, and the next shorter piece that begins it, or -1.
        self.sizes, self.shorter = [0] * n, [-1] * n
        for piece, i in self.reachable.items():
            self.sizes[i] = len(piece)
            self.shorter[i] = next((self.reachable[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.reachable), -1)
        self.most = max(self.sizes)
        self.bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Whether texts can't be cut before each line feed and each space mark.
        self.whole = any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids)
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, list[int]] = {}
        self.words: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """text's symbols after merging, again and again, the best pair (the first of equals)."""
        if len(text) > LONG:
            return self._merged_long(text)
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _merged_long(self, text: str) -> list[str]:
        """merged() with a heap of pairs and linked symbols."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(symbols):
                pair = symbols[left] + symbols[after[left]]
                if pair in self.score:
                    heapq.heappush(heap, (-self.score[pair], left, pair))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            if symbols[left] is None or right >= len(symbols) or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = pair, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [x for x in symbols if x is not None]

    def _compatible(self, a: int, b: int) -> bool:
        known = self.pairs[a << 20 | b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return known

    def _longest(self, part: str, place: int) -> int:
        """The longest piece that part has at place: at most the longest way into the automaton's trie."""
        size = self.matcher.longest_prefix(part[place : place + self.most])
        while (found := self.reachable.get(part[place : place + size])) is None:
            size -= 1
        return found

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part, all of whose characters are pieces."""
        n, pairs, sizes, shorter = len(part), self.pairs, self.sizes, self.shorter
        failed, tokens, last, place = bytearray(n // 8 + 1), [], -1, 0
        i = self._longest(part, 0)
        while place < n:
            while i >= 0:
                end = place + sizes[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | i)
                    if fits or fits is None and self._compatible(last, i):
                        break
                i = shorter[i]
            if i >= 0:
                tokens.append(i)
                last, place = i, end
                if place < n:
                    i = self._longest(part, place)
            else:
                failed[place >> 3] |= 1 << (place & 7)
                i = tokens.pop()
                place -= sizes[i]
                last, i = tokens[-1] if tokens else -1, shorter[i]
        return tokens

    def _cut(self, text: str) -> list[str]:
        """text, whose spaces are marks, cut between characters that aren't neighbours in any piece."""
        bigrams, out, start = self.bigrams, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in bigrams:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out

    def _learn(self, parts: set[str]) -> dict[str, list[int]]:
        """Ids of each part."""
        found, todo = {}, []
        for part in parts:
            if (known := self.parts.get(part)) is not None:
                found[part] = known
            elif len(part) == 1:
                found[part] = [self.ids[part]] if part in self.ids else [self.byte_ids.get(b, self.unknown) for b in part.encode()]
            elif MARK * 2 in part:
                found[part] = [self.ids[s] for s in self.merged(part)]
            else:
                todo.append(part)
        if len(self.parts) + len(todo) > CACHED // 2:
            self.parts.clear()
        for part in todo:
            ids = found[part] = self.encode_part(part)
            if len(part) < 100:
                self.parts[part] = ids
        return found

    def _escaped(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts whose spaces are marks already."""
        cut = [self._cut(text) for text in texts]
        known = self._learn({part for parts in cut for part in parts})
        return [[i for part in parts for i in known[part]] for parts in cut]

    def encode(self, text: str) -> list[int]:
        return self._escaped([MARK + text.replace(" ", MARK)])[0] if text else []

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        text = self._bytes(ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def _add(self, keys: list[str]) -> dict[str, str] | None:
        """Decimal ids, joined by commas, of words behind a mark or, where a key starts so, a line feed.

        None if decode() of some isn't the word again, which byte fallback rules out.
        """
        runs = [k if k[:1] == "\n" else MARK + k for k in keys]
        found = {}
        for key, run, ids in zip(keys, runs, self._escaped(runs)):
            if self._bytes(ids).decode("utf-8", "replace") != run:
                return None
            found[key] = ",".join(map(str, ids))
        if len(self.words) + len(found) > CACHED:
            self.words.clear()
        self.words.update({k: v for k, v in found.items() if len(k) < 100})
        return found

    def encode_decode(self, text: str) -> tuple[str, str]:
        """The ids of text, in decimal and joined by commas, and decode() of them."""
        if not text:
            return "", ""
        if self.whole or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":  # runs of marks are units
            ids = self.encode(text)
            return ",".join(map(str, ids)), self.decode(ids)
        keys = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = "\n" + words[0]
            keys += words
        keys[0] = keys[0][1:]
        found = list(map(self.words.get, keys))
        if None in found:
            added = self._add(list({k for k, ids in zip(keys, found) if ids is None}))
            if added is None:
                ids = self.encode(text)
                return ",".join(map(str, ids)), self.decode(ids)
            found = [added[k] if ids is None else ids for k, ids in zip(keys, found)]
        return ",".join(found), text  # each word decodes to itself, and decode() drops the first mark


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array), decoded, one row per row of docs.

    Exactly the library's ids, without begin or end, and its decode() of them. Null and empty texts have no ids and
    decode to ''; null doc_ids stay null. Texts of any length are encoded whole. Repeated rows give a row each, equal
    texts equal ids. Columns other than the two named stay behind, whatever their names; an empty table gives no rows.
    Nothing is shuffled; a worker holds one batch of texts and caches of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            found = [own.encode_decode((b or b"").decode("utf-8", "replace")) for b in batch["body"].to_pylist()]
            ids = pa.array([[int(x) for x in f[0].split(",")] if f[0] else [] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, pa.array([f[1] for f in found])], names=["doc_id", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: piece_tokens() as digests, made without building the arrays.

    Nulls, empty and long texts, repeated rows, other columns and empty tables as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for body in batch["body"].to_pylist():
                joined, text = own.encode_decode((body or b"").decode("utf-8", "replace"))
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
