import random
import re

import numpy as np
import pytest
import xxhash

from larkspur.llm import simhash
from larkspur.llm.components import components
from larkspur.llm.simhash import fingerprint, linked, near_dedup, position_sets, simhash_components, spanning_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """(id, fp) rows; the smallest id in reach, None last."""
    left, out = list(range(len(pairs))), {}
    rank = lambda i: (pairs[i][0] is None, pairs[i][0] or 0)
    while left:
        group, todo = [], [left.pop()]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4]
            left = [j for j in left if j not in near]
            todo += near
        for i in group:
            out[i] = pairs[min(group, key=rank)][0]
    return [out[i] for i in range(len(pairs))]


def test_documents_against_brute_force(spark, docs, odd):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(draw.choice(words) for _ in range(120)) for _ in range(8)]
    given = odd + [(100 + i, " ".join(draw.choice(base).split()[draw.randrange(3) : 120 - draw.randrange(3)])) for i in range(150)]
    fps = [(i, slow_fingerprint(t)) for i, t in given]
    found = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash_components(docs(given)).collect())
    assert found == sorted((repr(i), f"{fp:016x}", c) for (i, fp), c in zip(fps, slow_components(fps)))
    assert len({f[2] for f in found}) < 60


def test_count_filter_is_complete():
    draw = random.Random(1)
    masks = position_sets(4)
    assert len(masks) == 70
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randrange(0, 6)):
            b ^= 1 << bit
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        near = (a ^ b).bit_count() <= 4
        assert bool(linked(x, y, 4)[0]) == near
        assert not near or any((a & int(m)) == (b & int(m)) for m in masks)


@pytest.mark.parametrize("split", [2048, 10])
def test_spanning_links_connect_what_pairs_do(monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    draw = np.random.default_rng(split)
    for _ in range(20):
        seeds = draw.integers(0, 2**63, 4).astype(np.uint64)
        fps = np.unique(np.concatenate([s ^ (np.uint64(1) << draw.integers(0, 64, 25).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 25).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 25).astype(np.uint64)) for s in seeds]))
        a, b = spanning_links(fps, 4)
        slow = slow_components([(int(f), int(f)) for f in fps])
        fast = {int(f): int(f) for f in fps}
        fast.update(zip(a.tolist(), b.tolist()))
        assert [fast[int(f)] for f in fps] == slow and len(a) < len(fps)


def test_components_of_chains_and_hubs(spark):
    links = [(i + 1, i) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(-5000, 5001)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    names = {x for p in links for x in p}
    assert {r.node: r.component for r in found} == {x: 0 if 0 <= x <= 200 else 1000 if 0 < x < 5000 else -5000 for x in names}
    assert len(found) == len(names)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def chain(n, draw):
    """Texts whose fingerprints differ, each linked to the next: words are changed until a bit turns."""
    words, out = [f"w{draw.randrange(10**6)}" for _ in range(300)], []
    while len(out) < n:
        before = fingerprint(" ".join(words).encode())
        out.append(" ".join(words))
        while fingerprint(" ".join(words).encode()) == before:
            trial = list(words)
            trial[draw.randrange(300)] = f"w{draw.randrange(10**6)}"
            if (fingerprint(" ".join(trial).encode()) ^ before).bit_count() <= 4:
                words = trial
    return out


@pytest.mark.parametrize("same", [1, None])
def test_repeated_ids_with_linked_texts(spark, docs, same):
    """A row per row of docs, though one doc_id (or none) has several linked texts, in chains among others."""
    draw = random.Random(5)
    given = [(same, t) for t in chain(6, draw)] + [(i % 3 + 7, t) for i, t in enumerate(chain(9, draw))] + [(7, "far from all of these")]
    fps = [(i, slow_fingerprint(t)) for i, t in given]
    want = sorted((repr(i), f"{fp:016x}", repr(c)) for (i, fp), c in zip(fps, slow_components(fps)))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in simhash_components(docs(given)).collect()) == want
    assert len(want) == 16


def test_one_of_each_stays(spark, docs):
    text = " ".join(f"w{i}" for i in range(200))
    given = [(3, text), (1, text + " more"), (2, "quite another text here"), (9, "quite another text here"), (9, "quite another text here"), (4, None), (5, "")]
    left = near_dedup(docs(given))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4] and left.columns == docs(given).columns
    assert near_dedup(docs([(9, "a b"), (9, "a b")])).count() == 1


def test_short_and_empty(spark, docs):
    assert fingerprint(b"") == 0 == fingerprint(b" \n") and fingerprint(b"One two") == slow_fingerprint("one two")
    assert simhash_components(docs([])).count() == 0
