import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm.packing import Bpe, best_two_fit, pack_documents
from larkspur.llm.sentencepieces import PieceCodec, piece_digests, piece_tokens

BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


END = "<|endoftext|>"
#: The literal of an added token alone, inside words, doubled, at the ends, in parts, and beside white space.
MARKED = [END, f"a {END} b", f"in{END}side", END + END, f"{END} start", f"end {END}", f"{END}{END} x {END}", f"a  {END}  b", f"\n{END}\n", "<|endoftext", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", f"é{END}漢", f"it{END}'s"]


def _texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]


def test_pieces_as_the_library_has_them(spark, codec, library, odd):
    draw = random.Random(1)
    letters = "ab the▁ \n\t,.é漢🜁\x00　ing<>0xA"
    vocabulary = [p.replace("▁", " ") for p in codec.ids]
    texts = _texts(spark) + [t for _, t in odd if t] + ["", " ", "  a ", "\x00", "<s>", "<0x0A>", "▁▁a", "a  b", " " * 40, "x" * 500]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randrange(14))) for _ in range(3000)]
    texts += ["".join(draw.choice(vocabulary) for _ in range(draw.randrange(5))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.encode_decode(text) == (",".join(map(str, ids)), library.decode(ids)), text
        assert codec.decode(ids) == library.decode(ids)


def test_backtracking_against_merging(codec):
    draw = random.Random(8)
    parts = ["".join(draw.choice("etaoinshr▁"[: draw.randrange(3, 11)]) for _ in range(draw.randrange(1, 16))) for _ in range(3000)]
    parts = [p for p in parts if "▁▁" not in p]
    for part in parts:
        assert [codec.pieces[i] for i in codec.encode_part(part)] == codec.merged(part)


def test_long_runs(codec, library):
    draw = random.Random(3)
    for text in [" " * 20_000 + "word", "x" * 20_000, "ab" * 10_000, "".join(draw.choice("etao ") for _ in range(20_000)), "".join(draw.choice("etaoin") for _ in range(20_000)), "é漢" * 5000]:
        assert codec.encode(text) == library.encode(text)
        assert codec.merged("▁" + text.replace(" ", "▁")[:3000]) == codec._merged_long("▁" + text.replace(" ", "▁")[:3000])


def test_piece_tables(spark, docs, odd, library):
    want = sorted((repr(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in odd)
    assert sorted((repr(r.doc_id), r.ids, r.decoded) for r in piece_tokens(docs(odd), PIECES).collect()) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digests(docs(odd), PIECES).collect())
    assert found == sorted((i, len(ids), sha(",".join(map(str, ids))), sha(text)) for i, ids, text in want)
    assert piece_tokens(docs([]), PIECES).count() == 0


def test_bpe_as_the_library_has_it(spark, tokenizer, odd):
    model, draw = Bpe(BPE), random.Random(2)
    letters = "ab the's \n\t,.é漢\x85\xa0\x1c12 x\n  \n"
    texts = _texts(spark) + [t for _, t in odd if t] + ["", "\x00"] + MARKED + ["".join(draw.choice(letters) for _ in range(draw.randrange(14))) for _ in range(5000)]
    for text in texts:
        assert model.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    with pytest.raises(ValueError):
        Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(spark, docs, odd, tokenizer):
    given = odd + [(100 + i, "some words " * (i * 37 % 700)) for i in range(300)] + [(500 + i, t) for i, t in enumerate(MARKED)] + [(600, f"long text {END} " * 900)]
    rows = pack_documents(docs(given).repartition(5), BPE).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want, texts = defaultdict(Counter), defaultdict(list)
    for i, t in given:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want[i].update((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
        texts[i].append(t)
    assert {i: Counter((r.piece, r.start, r.length, r.ids_crc32) for r in own) for i, own in pieces.items()} == want
    assert max(map(len, texts.values())) > 1 and max(sum(own.values()) for own in want.values()) > 3
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    assert sum(1 for r in rows if r.doc_id == 7) == 2
    assert pack_documents(docs([]), BPE).count() == 0


def test_two_for_one():
    """Greedy takes 6 and 3 of a room of 10; 2 and 2 fill the rest more tightly than 3."""
    assert (1, (6, 2, 2)) in best_two_fit({6: 1, 3: 1, 2: 2}, 10)


def test_all_lengths_are_placed():
    draw = random.Random(6)
    for _ in range(50):
        counts = {draw.randrange(1, 65): draw.randrange(1, 50) for _ in range(draw.randrange(1, 20))}
        used = defaultdict(int)
        for times, lengths in best_two_fit(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
