"""Near copies by exact similarity, against brute force."""

import random

import pytest

import corpus_pipeline as p
from larkspur.llm import near_copies
from larkspur.llm.near_copies import similar_dedup
from larkspur.llm.simhash import fingerprint


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_firsts(given):
    """Doc_ids that stay: the smallest of each component, null last."""
    sets, group = [shingled(t) for _, t in given], list(range(len(given)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and bool(a) == bool(b):
                group = [group[i] if g == group[j] else g for g in group]
    rank = lambda i: (given[i][0] is None, given[i][0] or 0)
    return {given[min((i for i in range(len(given)) if group[i] == g), key=rank)][0] for g in set(group)}


def changed(draw, text, times):
    words = text.split()
    for k in range(times):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("small,block", [(16, 2048), (2, 2048), (2, 5)])
def test_against_brute_force(spark, docs, odd, monkeypatch, small, block):
    """Small bands reach the path of large ones, where the pairs with the least member don't connect all; in blocks too."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    draw = random.Random(small)
    base = [" ".join(f"w{draw.randrange(500)}" for _ in range(draw.choice([12, 60, 200]))) for _ in range(12)]
    given = odd + [(100 + i, changed(draw, t := draw.choice(base), draw.randrange(1 + len(t.split()) // 30))) for i in range(150)]
    kept = slow_firsts(given)
    assert {r.doc_id for r in similar_dedup(docs(given)).collect()} == kept and len(kept) < 120


def test_stage_follows_similarity_not_bits(spark):
    """Pairs that share 0.8 of their shingles go though their fingerprints are over 4 bits apart, and no others."""
    draw, rows, far = random.Random(7), [], 0
    for i in range(30):
        text = " ".join(f"w{draw.randrange(10**6)}" for _ in range(100))
        other = changed(draw, text, 1 if i % 2 else 4)
        far += i % 2 and (fingerprint(text.encode()) ^ fingerprint(other.encode())).bit_count() > 4
        rows += [(2 * i, text, "en", "s", len(text)), (2 * i + 1, other, "en", "s", len(other))]
    assert far
    out = p.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id for r in out.collect()} == slow_firsts([r[:2] for r in rows])


def test_repeated_and_empty(spark, docs):
    assert similar_dedup(docs([])).count() == 0
    left = similar_dedup(docs([(9, "a b"), (9, "a b"), (None, "a b"), (None, "x y")]))
    assert sorted(repr(r.doc_id) for r in left.collect()) == ["9", "None", "None"] and left.columns == docs([]).columns


def test_fingerprint_index_alone_gives_verified_links(spark, docs, monkeypatch):
    """Without any band, copies within 4 bits go, as far as they share 0.8; equal fingerprints of other sets count too."""
    monkeypatch.setattr(near_copies, "candidates", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long, band long"))
    draw, given, close = random.Random(11), [], 0
    fp = lambda text: near_copies.majority(near_copies.shingles(text.encode()))
    for i in range(0, 60, 2):
        text = " ".join(f"w{draw.randrange(10**6)}" for _ in range(400))
        other = changed(draw, text, 1 if i % 4 else 30)
        given += [(i, text), (i + 1, other)]
        close += (fp(text) ^ fp(other)).bit_count() <= 4
    left = {r.doc_id for r in similar_dedup(docs(given)).collect()}
    assert 0 < close < 30 and len(given) - len(left) == close
    assert left >= slow_firsts(given)


def test_close_fingerprints_of_unlike_sets_do_not_link(spark, docs, monkeypatch):
    """All fingerprints are equal: whatever the index gives is verified, so the rows are those of a brute force."""
    monkeypatch.setattr(near_copies, "majority", lambda hashes: 5)
    draw = random.Random(12)
    given = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    given += [(100 + i, changed(draw, t, i % 3)) for i, t in given]
    assert {r.doc_id for r in similar_dedup(docs(given)).collect()} == slow_firsts(given)
