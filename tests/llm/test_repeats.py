import random
import re

import numpy as np
import pytest
import xxhash

import larkspur.llm.line_dedup as line_dedup_module
from larkspur.llm import repeats
from larkspur.llm.common import documents
from larkspur.llm.line_dedup import line_dedup
from larkspur.llm.substring_dedup import FingerprintIndex, _batches, substring_dedup
from larkspur.llm.windows import window_hashes, window_minima

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text):
    return [x for x in (y.strip(SPACE) for y in text.split("\n")) if x]


def brute(given, units_of, window):
    """Which units go, for each (doc_id, text); equal rows are one document."""
    seen, out = {}, {}
    order = sorted(set(given), key=lambda r: (r[0] is None, r[0] or 0, __import__("zlib").crc32((r[1] or "").encode())))
    for doc, text in order:
        units = units_of(text or "")
        gone = [False] * len(units)
        for s in range(len(units) - window + 1):
            key = tuple(units[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.setdefault(key, (doc, s))
        out[doc, text] = gone
    return out


def test_hashes_of_windows():
    units = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    units[30:45] = units[5:20]
    for size in range(1, 21):
        keys = window_hashes(units, size)
        assert len(keys) == 61 - size
        for i in range(len(keys)):
            for j in range(i):
                assert (keys[i] == keys[j]) == (units[i : i + size].tolist() == units[j : j + size].tolist())
    assert window_hashes(units, 61).tolist() == []


def test_checks_are_of_bytes():
    """Words whose own hashes collide have different checks: these are hashes of what is joined."""
    units = [b"a", b"bc", b"", b"a", b"bc", b"ab", b"c"]
    start, stop = np.array([0, 3, 0, 5, 1]), np.array([2, 5, 3, 7, 2])
    a, b, c, d, e = repeats.checks(units, start, stop).tolist()
    assert a == b == xxhash.xxh3_64_intdigest(b"a bc", repeats.CHECK_SEED) and len({a, c, d, e}) == 4


def test_colliding_word_hashes_do_no_harm(spark, docs, monkeypatch):
    """All words hash alike, so all keys are equal: the checks alone tell windows apart."""
    monkeypatch.setattr(repeats, "xxh3_64_intdigest", lambda x, seed=0: xxhash.xxh3_64_intdigest(x, seed) if seed else 7)
    for _, body in [(1, " ".join(f"p{i}" for i in range(40))), (2, " ".join(f"q{i}" for i in range(40)))]:
        keys, checks_, _, _ = repeats.blocks(body.encode().split(), 20, 7)
        assert len(set(keys.tolist())) == 1 and len(set(checks_.tolist())) == len(checks_)


def test_minima():
    keys = np.array([5, 3, 3, 9, 1, 8, 7], np.uint64)
    assert window_minima(keys, 3).tolist() == [1, 1, 4, 4, 4]


@pytest.mark.parametrize("at_once,hot", [(1 << 19, 64), (300, 3)])
@pytest.mark.parametrize("batches", [1, 3])
def test_substrings_against_brute_force(spark, docs, odd, monkeypatch, batches, at_once, hot):
    """Passages at odd places, so that blocks differ at the edges; small limits reach the hot and the split paths."""
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    monkeypatch.setattr(repeats, "HOT", hot)
    draw = random.Random(batches)
    words = [f"w{i}" for i in range(400)]
    passages = [[draw.choice(words) for _ in range(draw.randrange(15, 70))] for _ in range(6)]
    given = list(odd)
    for i in range(120):
        text = []
        for _ in range(draw.randrange(1, 5)):
            text += [draw.choice(words) for _ in range(draw.randrange(0, 30))]
            p = draw.choice(passages)
            a = draw.randrange(0, 10)
            text += p[a : a + draw.randrange(10, 60)]
        given.append((100 + i, draw.choice([" ", "\n", "\t "]).join(text)))
    expected = brute(given, WORD.findall, 20)
    out = substring_dedup(docs(given), batches=batches, spaced=True, keep=("size",)).collect()
    assert len(out) == len(given) and all(r.size == "x" for r in out)
    found = sorted((repr(r.doc_id), r.n_units, r.n_removed, r.text) for r in out)
    want = sorted((repr(i), len(g := expected[i, t]), sum(g), None if t is None else " ".join(w for w, x in zip(WORD.findall(t), g) if not x)) for i, t in given)
    assert found == want
    assert sum(w[2] for w in want) > 1000


def test_spans_and_separators(spark, docs):
    passage = " ".join(f"p{i}" for i in range(25))
    given = [(1, f"start\n{passage}\nend"), (2, f"  other\t{passage}\n\nrest ")]
    two = {r.doc_id: r for r in substring_dedup(docs(given, clash=False)).collect()}[2]
    assert two.text == "  other\trest " and [tuple(s) for s in two.removed] == [(1, 26)] and two.n_removed == 25


def test_index_over_batches(spark, docs, tmp_path):
    passage = " ".join(f"p{i}" for i in range(40))
    index = FingerprintIndex(spark, str(tmp_path / "index"), 20, 7, 5, most_runs=1)
    given = [(1, passage), (2, "x " + passage), (3, passage + " y"), (4, passage)]
    marks = [index.add(documents(docs([g], clash=False))).where(f"kind = {repeats.MARKS}").count() for g in given]
    assert len(index.runs) == 1 and index.state["compactions"] == 3 and marks[0] == 0 and marks[3] > 0
    index.remove()
    assert not (tmp_path / "index").exists()


def test_compaction_leaves_one_sorted_run(spark, docs, tmp_path):
    index = FingerprintIndex(spark, str(tmp_path / "index"), 20, 7, 5, most_runs=9)
    for i in range(3):
        index.add(documents(docs([(i, " ".join(f"w{i}-{j}" for j in range(200)))], clash=False)))
    before = [repeats._entries_of(r.blob) for r in index._read(repeats.RUN).collect()]
    assert len(index.runs) == 3 and len(list((tmp_path / "index").glob("runs-*"))) == 1
    index.compact()
    rows = index._read(repeats.RUN).collect()
    after = [repeats._entries_of(r.blob) for r in rows]
    assert len(index.runs) == 1 and len({r.bucket for r in rows}) == len(rows) and not (tmp_path / "index" / "runs-0").exists()
    keys = lambda parts: sorted(k for p in parts for k in zip(p["key"].tolist(), p["check"].tolist(), p["doc"].tolist()))
    assert keys(before) == keys(after) and all((p["key"][1:] >= p["key"][:-1]).all() for p in after)
    index.remove()


def test_query_compacts(spark, docs, monkeypatch):
    """Four batches and two runs: the index of the registered query is compacted on its way."""
    calls = []
    whole = FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (calls.append(len(self.runs)), whole(self)))
    substring_dedup(docs([(i, f"text number {i} " * 20) for i in range(40)])).count()
    assert calls == [3]


def test_history_is_merged_without_a_shuffle(spark, docs, tmp_path):
    index = FingerprintIndex(spark, str(tmp_path / "index"), 20, 7, 8)
    index.add(documents(docs([(1, "a b " * 60)], clash=False)))
    old = index._read(repeats.RUN)
    plan = old.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(lambda a, b: a, repeats_schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    index.remove()


repeats_schema = "bucket int, kind int, blob binary"


def test_kept_index_gives_what_one_call_gives(spark, docs, tmp_path):
    """Documents that come in three calls, each with the index the last one left, opened anew."""
    draw = random.Random(12)
    passages = [[f"p{k}-{i}" for i in range(60)] for k in range(4)]
    given = []
    for i in range(60):
        p = draw.choice(passages)
        a = draw.randrange(0, 20)
        given.append((i, " ".join([f"own{i}"] * draw.randrange(3) + p[a : a + draw.randrange(15, 40)] + [f"end{draw.randrange(9)}"])))
    want = {r.doc_id: (r.n_removed, r.text) for r in substring_dedup(docs(given)).collect()}
    found = {}
    for low, high in ((0, 20), (20, 45), (45, 60)):
        index = FingerprintIndex(spark, str(tmp_path / "index"), 20, 7, 9, most_runs=1)
        assert bool(index.runs) == (low > 0)
        rows = substring_dedup(docs(given[low:high]), batches=1, index=index, history=docs(given[:low]) if low else None)
        found |= {r.doc_id: (r.n_removed, r.text) for r in rows.collect()}
    assert found == want and sum(n for n, _ in want.values()) > 500
    with pytest.raises(ValueError):
        substring_dedup(docs(given[:3]), index=index)
    with pytest.raises(ValueError):
        substring_dedup(docs(given[:3]), window=10, index=index, history=docs(given))
    index.remove()


def test_batches_cover_all(spark, docs, odd):
    parts = _batches(docs(odd, clash=False), 3)
    assert sum(p.count() for p in parts) == len(odd)
    assert _batches(docs([], clash=False), 3)[0].count() == 0


def left_of(text, gone):
    if text is None or not any(gone):
        return text
    going = iter(gone)
    return "\n".join(x for x in text.split("\n") if not (x.strip(SPACE) and next(going)))


@pytest.mark.parametrize("window,at_once", [(4, 1 << 17), (2, 40), (9, 25)])
def test_lines_against_brute_force(spark, docs, odd, monkeypatch, window, at_once):
    """Runs, lone lines and hot ones; the number of lines in a window and of entries a task holds change nothing."""
    monkeypatch.setattr(line_dedup_module, "AT_ONCE", at_once)
    draw = random.Random(4)
    pool = [f"line number {i}" for i in range(300)] + ["", "  "] + ["same"] * 60
    given = odd + [(100 + i, "\n".join(draw.choice(pool) + draw.choice(["", " "]) for _ in range(draw.randrange(0, 14)))) for i in range(150)]
    for i in range(60):  # runs of other texts, between lines of their own
        source = draw.choice(given[-150:])[1] or ""
        some = source.split("\n")
        a = draw.randrange(len(some))
        given.append((300 + i, "\n".join([f"own {i}", *some[a : a + draw.randrange(9)], f"end {i}"])))
    given.append((None, given[-1][1]))
    expected = brute(given, lines_of, 1)
    found = sorted((repr(r.doc_id), r.n_units, r.n_removed, r.text) for r in line_dedup(docs(given).repartition(3), window=window).collect())
    assert found == sorted((repr(i), len(g := expected[i, t]), sum(g), left_of(t, g)) for i, t in given)


def test_places_are_extended_both_ways():
    """One shared fingerprint finds the whole run around it."""
    one, two = ([f"{c}{i}".encode() for i in range(3)] for c in "ab")
    shared = [f"s{i}".encode() for i in range(9)]
    parts = [line_dedup_module.segments(x + shared + y, doc, 0, 5) for doc, (x, y) in enumerate([(one, two), (two, one)])]
    first, spans, lone = line_dedup_module.extend({n: np.concatenate([p[n] for p in parts]) for n in parts[0]}, 5)
    covered = {i for d, a, c in zip(spans["doc"], spans["start"], spans["count"]) if d == 1 for i in range(a, a + c)}
    assert covered >= set(range(3, 12)) and set(spans["doc"].tolist()) == {1}
    assert len(spans["start"]) < 9  # few fingerprints, many lines
    assert all(int(s) not in range(3, 12) for part in lone for s in part["start"])


def test_lone_and_repeated_lines(spark, docs):
    given = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "z\nb\n\nz"), (4, "d")]
    assert [r.text for r in line_dedup(docs(given)).orderBy("doc_id").collect()] == ["a\nb\nc\nd", "x\ny", "z\n", ""]


def test_empty_tables(spark, docs):
    assert substring_dedup(docs([])).count() == 0 and line_dedup(docs([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup(docs([]), keep=("body",))
