import math
import random

import numpy as np

from larkspur.llm import url_filter
from larkspur.llm.common import mix
from larkspur.llm.url_filter import RULES, UrlModel, judge_urls, labelled


def slow_score(model, host, path):
    """One n-gram at a time."""
    slots = []
    for salt, part in ((1, host), (2, path.lower())):
        body = ("^" + "".join("0" if c in "123456789" else c for c in part) + "$").encode()
        for n in (3, 4, 5):
            for i in range(len(body) - n + 1):
                key = salt * 16 + n
                for c in body[i : i + n]:
                    key = (key << 8 | c) % 2**64
                slots.append(int(mix(np.array([key], np.uint64))[0]) % 8192)
    total = sum(model.weights[s] for s in slots) / max(1, len(slots)) ** 0.5
    return 1 / (1 + math.exp(-total - model.bias))


def slow(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        ends = [i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[: ends[0]])
        rest = rest[ends[0] :]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"] or [len(rest)])]
    best = None
    for name, start, verdict in RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = (name + start, verdict)
    model = slow.model
    return host, path, best and best[0], best[1] if best else ("block" if slow_score(model, host, path) >= 0.5 else "allow")


slow.model = UrlModel()

URLS = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/x", "https://www.example.com/en/1?a=/b", "http://a.b.example.com/en/", "http://notexample.com/en/", "http://com/", "http://com", "ftp://x.net/es/1#y", "http://x.net?q=/es/", "http://x.net/fr", "http://x.NET/fr/", "http://net/es/", "http://a://b/c", "http://host#frag/x", "x://É.org/\n/y", "http://cheap-pills.example.org/en/1", "http://a.org/" + "p" * 5_000]


def test_against_brute_force(spark):
    rows = [(i, u, "host", "rule") for i, u in enumerate(URLS)] + [(None, "http://x.com/", "h", "r"), (1, "http://x.com/", "h", "r")]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()
    assert sorted((repr(r.page_id), r.host, r.path, repr(r.rule), r.verdict) for r in found) == sorted((repr(i), h, p, repr(rule), v) for i, u, *_ in rows for h, p, rule, v in [slow(u)])


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert found == {r.page_id: slow(r.url) for r in pages.collect()}


def test_batches_of_any_size_score_alike(monkeypatch):
    rows = labelled()[:60] + [("x" * 4000, "/" + "é" * 4000, 0), ("", "", 0)]
    whole = slow.model.scores([r[0] for r in rows], [r[1] for r in rows])
    monkeypatch.setattr(url_filter, "AT_ONCE", 50)
    assert np.allclose(whole, slow.model.scores([r[0] for r in rows], [r[1] for r in rows]), atol=1e-12)
    assert np.allclose(whole[:60], [slow_score(slow.model, h, p) for h, p, _ in rows[:60]], atol=1e-12)
    assert len(slow.model.scores([], [])) == 0


#: Names apart from those that the model learns from.
CLEAN = "aquarium orchestra carpentry astronomy gymnasium observatory cathedral vineyard lighthouse botany ceramics philosophy swimming knitting folklore geology parliament citizens volunteers hospital".split()


def test_learns_its_table_and_judges_unseen_hosts():
    table = labelled()
    found = slow.model.scores([r[0] for r in table], [r[1] for r in table]) >= 0.5
    assert np.mean(found == [r[2] for r in table]) > 0.98
    seen = {h for h, _, _ in table}
    fresh = [r for r in labelled(seed=99, rows=3000) if r[0] not in seen]
    block = slow.model.scores([r[0] for r in fresh], [r[1] for r in fresh]) >= 0.5
    truth = np.array([r[2] for r in fresh], bool)
    assert block[truth].mean() > 0.9 and block[~truth].mean() < 0.02
    draw = random.Random(4)
    clean = [f"{draw.choice(['', 'www.'])}{a}{draw.choice(['', '-' + b])}.org" for a in CLEAN for b in CLEAN]
    assert (slow.model.scores(clean, [""] * len(clean)) >= 0.5).mean() < 0.05


def test_rules_leave_the_model_out(spark):
    rows = judge_urls(spark.createDataFrame([(1, "http://x.com/", "s"), (2, "http://x.org/", "s")], "page_id long, url string, score string")).collect()
    assert {r.page_id: r.score is None for r in rows} == {1: True, 2: False}


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
