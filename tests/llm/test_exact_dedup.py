import hashlib
import random
import re

from larkspur.llm.exact_dedup import CuckooFilter, CuckooIndex, exact_dedup


def _key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_inserts_deletes_and_resizes():
    index, live = CuckooIndex(4), {}
    draw = random.Random(5)
    for turn in range(20_000):
        i = draw.randrange(3000)
        if i in live and draw.random() < 0.5:
            assert index.delete(_key(i))
            del live[i]
        elif i not in live:
            index.insert(_key(i), [turn])
            live[i] = turn
    assert index.live == len(live) and index.filter.size > 4
    assert all((index.get(_key(i)) or [None])[0] == live.get(i) for i in range(3000))
    assert not index.delete(_key(-1))
    assert sorted(k for k, _ in index.items()) == sorted(map(_key, live))


def test_hit_is_verified():
    index = CuckooIndex()
    index.insert(b"ab" + b"\x00" * 30, [1])
    assert index.get(b"ab" + b"\x00" * 29 + b"\x01") is None and index.false_hits == 1  # the content's bucket is the same
    assert index.get(b"cd" + b"\x00" * 30) is None and index.false_hits == 1  # the filter alone says no


def test_filter_holds_marks_and_overflows():
    small = CuckooFilter(2)
    taken = [small.insert(_key(i)) for i in range(9)]
    assert not all(taken) and taken[0]
    wide = CuckooFilter(1 << 10)
    assert all(wide.insert(_key(i)) for i in range(3000)) and all(wide.has(_key(i)) for i in range(3000))
    assert all(0 < m < 1 << 16 for bucket in wide.table for m in bucket)
    assert sum(wide.has(_key(-i)) for i in range(1, 20_001)) < 20
    for i in range(1500):
        wide.delete(_key(i))
    assert all(wide.has(_key(i)) for i in range(1500, 3000)) and sum(map(len, wide.table)) == 1500


def _expected(given):
    groups = {}
    for i, t in given:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest(), []).append((-len(t or ""), i is None, i))
    out = []
    for digest, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(i, rows[0][2], len(rows), nth == 0, digest) for nth, (_, _, i) in enumerate(rows)]
    return sorted(out, key=repr)


def _found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_against_brute_force(spark, docs, odd):
    draw = random.Random(2)
    given = odd + [(100 + i, draw.choice(["a b", "ab", " a b", "A b", "c\td", "c d  "])) for i in range(300)]
    assert _found(exact_dedup(docs(given))) == _expected(given)


def test_one_row_of_each_group_stays(spark, docs):
    """Also where rows share a doc_id and a length, with other white space or none."""
    given = [(3, "a b c"), (3, "ab c "), (3, "a b c"), (None, "x"), (None, "x"), (4, None), (4, ""), (5, " ")]
    for parts in (1, 3):
        rows = _found(exact_dedup(docs(given).repartition(parts)))
        assert rows == _expected(given) and sum(r[3] for r in rows) == len({r[4] for r in rows}) == 3


def test_empty(spark, docs):
    assert exact_dedup(docs([])).count() == 0


def test_hot_group(spark, docs):
    given = [(i, "hot text" if i % 3 else f"own {i}") for i in range(3000)]
    assert _found(exact_dedup(docs(given).repartition(7))) == _expected(given)
