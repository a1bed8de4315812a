"""The pipeline's stages on their own inputs, against what the definitions give."""

import numpy as np
import pytest
import public_tokenizers
from test_near_copies import slow_firsts
from test_repeats import WORD, brute, left_of, lines_of
from tokenizers import Tokenizer

import corpus_pipeline as p

from conftest import CLASHES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, tmp_path):
    docs, n = spark.read.parquet(f"{SF}/documents.parquet"), 0

    def step(stage):
        nonlocal n
        n += 1
        path = str(tmp_path / str(n))
        stage(spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = step(p.quality)
    left = {r.doc_id for r in out.collect()}
    assert out.columns == COLUMNS and set(_rows(out)) <= set(_rows(docs))
    assert np.mean([(i in left) == bool(q) for i, q in labels.items()]) > 0.97

    docs, out = out, None
    out = step(p.lines)
    gone = brute(_rows(docs), lines_of, 1)
    assert out.columns == COLUMNS and [(i, len(lines_of(t))) for i, t in _rows(out)] == [(i, len(gone[i, t]) - sum(gone[i, t])) for i, t in _rows(docs)]
    assert all(r.n_chars == len(r.text) for r in out.collect())

    docs = out
    out = step(p.near_copies)
    firsts = slow_firsts(_rows(docs))
    assert out.columns == COLUMNS and _rows(out) == [r for r in _rows(docs) if r[0] in firsts]

    docs = out
    out = step(p.substrings)
    gone = brute(_rows(docs), WORD.findall, 20)
    assert out.columns == COLUMNS and [(i, WORD.findall(t)) for i, t in _rows(out)] == [(i, [w for w, g in zip(WORD.findall(t), gone[i, t]) if not g]) for i, t in _rows(docs)]

    docs = out
    out = step(p.packing).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in out) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in _rows(docs))
    assert {r.doc_id for r in out} == {i for i, _ in _rows(docs)}

    whole = p.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out)


def table(spark, rows):
    """documents() with every name that operators use inside as one more column; lang and source may be null."""
    names = [c for c in CLASHES if c not in COLUMNS]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), *["x"] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))


def _shown(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("stage", [s for s in p.STAGES], ids=[n for n, _ in p.STAGES])
def test_stage_on_odd_rows(spark, odd, stage):
    """Null ids and texts, empty and very long ones, repeated rows and ids with other texts, clashing columns."""
    name, run = stage
    given = odd + [(7, "another text of document seven"), (1, None), (20, odd[0][1] + " more"), (21, "line one"), (22, odd[12][1])]
    docs = table(spark, given)
    out = run(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert sum(1 for r in rows if r.piece == 0) == len(given) and all(r.length <= 1024 for r in rows)
        return
    assert out.columns == COLUMNS and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    found = _shown((r.doc_id, r.text) for r in rows)
    if name == "quality":
        assert set(found) <= set(_shown(given))
    elif name == "lines":
        gone = brute(given, lines_of, 1)
        assert found == _shown((i, left_of(t, gone[i, t])) for i, t in given)
    elif name == "near_copies":
        firsts = slow_firsts(given)
        assert found == _shown({(i, t) for i, t in given if i in firsts})
    else:
        gone = brute(given, WORD.findall, 20)
        want = [(i, None if t is None else [w for w, g in zip(WORD.findall(t), gone[i, t]) if not g]) for i, t in given]
        assert _shown((r.doc_id, None if r.text is None else WORD.findall(r.text)) for r in rows) == _shown(want)


@pytest.mark.parametrize("stage", [s for s in p.STAGES], ids=[n for n, _ in p.STAGES])
def test_stage_on_an_empty_table(spark, stage):
    out = stage[1](spark, table(spark, []), SF)
    assert out.count() == 0 and (stage[0] == "packing" or out.columns == COLUMNS)


def test_stages_call_the_operators_in_order():
    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_copies", "substrings", "packing"]
