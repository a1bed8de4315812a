import zlib
from collections import defaultdict

from larkspur.llm.sharding import shard_by_bytes


def _check(rows, given, shards):
    assert sorted((str(i), s, c) for i, s, c, *_ in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    by = defaultdict(list)
    for _, size, _, shard, slot in rows:
        by[shard].append((slot, size))
    for part in by.values():
        assert sorted(s for s, _ in part) == list(range(len(part)))
    assert set(by) <= set(range(shards))
    return by


def test_balanced_contiguous_and_gapless(spark, docs):
    given = [(i, "w" * (i * 7919 % 311)) for i in range(2000)]
    out = shard_by_bytes(docs(given), 16)
    by = _check([tuple(r) for r in out.collect()], given, 16)
    sizes = [sum(s for _, s in part) for part in by.values()]
    assert len(by) == 16 and max(sizes) - min(sizes) <= 2 * 312
    rows = sorted(out.collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_odd_rows(spark, docs, odd):
    _check([tuple(r) for r in shard_by_bytes(docs(odd), 4).collect()], odd, 4)


def test_ties_of_one_id(spark, docs):
    given = [(1, "same")] * 500
    by = _check([tuple(r) for r in shard_by_bytes(docs(given), 5).collect()], given, 5)
    assert [len(by[k]) for k in range(5)] == [100] * 5


def test_empty_and_kept_columns(spark, docs):
    assert shard_by_bytes(docs([]), 16).count() == 0
    assert shard_by_bytes(docs([(1, "a")]), 2, keep=("text",)).first().text == "a"


def test_plan_is_native(spark, docs):
    plan = shard_by_bytes(docs([(1, "a")]), 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
