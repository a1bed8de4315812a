import re
import zlib
from collections import Counter

import numpy as np

from larkspur.llm.quality_classifier import Network, pooled, quality_model, score_quality, scored
from larkspur.llm.quality_rules import measure, quality_votes, weigh

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measure(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_figures(spark, odd):
    texts = [t for _, t in odd if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts + ["a b c d e a b c d e f", "a a a a a a", "x\nx \nx\n\n\n"]:
        assert measure(text.encode())[:5] == slow_measure(text)


def test_rules(spark, docs, odd):
    rows = quality_votes(docs(odd)).collect()
    assert len(rows) == len(odd) and not any(r.kept for r in rows if r.n_words < 10)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert quality_votes(docs([])).count() == 0


def slow_votes(text):
    """The six votes of one text: 0 bad, 1 abstains, 2 good."""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    _, _, symbols, again, _ = slow_measure(text)
    rows = [x for x in text.split("\n") if WORD.search(x)]
    upper = sum("A" <= c <= "Z" for c in text)
    letters = upper + sum(1 if "a" <= c <= "z" else len(c.encode()) if ord(c) > 127 else 0 for c in text)
    ended = sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" for x in rows)
    return (
        0 if 2 * chars < 5 * n or chars > 13 * n else 1,
        0 if 10 * symbols > n else 2 if 50 * symbols <= n else 1,
        0 if 2 * again > len(rows) else 1,
        0 if 2 * upper > letters else 1,
        0 if 2 * letters < chars else 1,
        0 if ended == 0 and len(rows) > 2 else 2 if 2 * ended >= len(rows) else 1,
    )


def slow_estimate(all_votes, rounds=40, trust=0.05):
    """Expectation-maximisation one text at a time: the posterior of each."""
    good = [0.1 if 0 in v else 0.9 for v in all_votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(good) + 2)
        rates = []
        for weight in ([1 - g for g in good], good):
            total = sum(weight)
            rates.append([[(sum(w for w, v in zip(weight, all_votes) if v[k] == x) + 0.5) / (total + 1.5) for x in range(3)] for k in range(6)])
        for k in range(6):
            rates[1][k][0] = min(rates[1][k][0], trust * rates[0][k][0])
            rates[0][k][2] = min(rates[0][k][2], rates[1][k][2])
            for r in rates:
                r[k][1] = 1 - r[k][0] - r[k][2]
        for i, v in enumerate(all_votes):
            one, none = share, 1 - share
            for k in range(6):
                one, none = one * rates[1][k][v[k]], none * rates[0][k][v[k]]
            good[i] = one / (one + none)
    return good


def test_votes_posterior_and_kept_against_brute_force(spark, docs, odd):
    """Every text on its own, no patterns and no arrays; whole documents with odd rows and repeated ones among them."""
    given = odd + [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(5000, "#### $$$$ %%%% " * 9), (5001, "A B C D E F G H I J K L"), (5002, "one\ntwo\nthree\nfour\nfive six seven eight nine ten")]
    names = ["v_word_size", "v_symbols", "v_lines", "v_capitals", "v_letters", "v_ended"]
    every = [slow_votes(t or "") for _, t in given]
    chances = slow_estimate(every)
    want = []
    for (i, t), v, p in zip(given, every, chances):
        n, _, _, _, repeat = slow_measure(t or "")
        failed = n < 10 or 100 * repeat > 20 * n
        want.append((repr(i), v, round(p, 9), failed, not failed and p >= 0.5))
    rows = quality_votes(docs(given)).collect()
    assert sorted((repr(r.doc_id), tuple(r[c] for c in names), round(r.posterior, 9), r.base_failed, r.kept) for r in rows) == sorted(want)
    assert len({w[4] for w in want}) == 2 and len(set(every)) > 8


def test_rules_part_good_and_bad(spark):
    rows = quality_votes(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    assert all(r.kept for r in judged if r.good)
    assert np.mean([not r.kept for r in judged if not r.good]) > 0.9


def test_estimate_finds_the_rare_class():
    draw = np.random.default_rng(1)
    good = draw.random(5000) < 0.9
    votes = np.where(draw.random((5000, 6)) < 0.3, 1, 2)
    votes[:, :3] = np.where(~good[:, None] & (draw.random((5000, 3)) < 0.6), 0, votes[:, :3])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, rates = weigh(patterns, counts.astype(float))
    assert 0.6 < share < 0.97 and (rates[0, :3, 0] > 10 * rates[1, :3, 0]).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    one, two = ({r.doc_id: r.score for r in score_quality(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_scores_do_not_depend_on_partitions(spark):
    """Sums of whole numbers: the same bits whatever the number of tasks."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    one, two = ({r.doc_id: r.score for r in score_quality(docs.repartition(n), labels).collect()} for n in (1, 7))
    assert one == two


def test_odd_rows_and_labels(spark, docs, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (8, None), (None, 1), (999, 1), (10, 0), (11, 1)], "doc_id long, quality int")
    rows = score_quality(docs(odd), labels).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3, 4)} == {next(r.score for r in rows if r.doc_id == 2)}
    assert {r.score for r in score_quality(docs(odd), labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs([]), labels).count() == 0
    assert "score" in scored(docs(odd), quality_model(docs(odd), labels), score_col="score").columns


def test_network_is_calibrated():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    y = (draw.random(4000) < p).astype(float)
    found = Network(x[:3000], y[:3000]).score(x[3000:])
    assert abs(found.mean() - p[3000:].mean()) < 0.05 and np.corrcoef(found, p[3000:])[0, 1] > 0.95


def test_pooling_ignores_neighbours():
    vectors = np.random.default_rng(0).normal(size=(2 << 14, 32)).astype(np.float32)
    bodies = [b"a b c", b"", b"a a a", b"A1 ## x"]
    whole = pooled(bodies, vectors)
    for i, b in enumerate(bodies):
        assert np.allclose(pooled([b], vectors)[0], whole[i], atol=1e-6)
    assert not whole[1].any()


def test_a_labelled_id_in_most_rows_is_learnt_from_once(spark, docs, monkeypatch):
    fitted, plain = [], Network.__init__
    monkeypatch.setattr(Network, "__init__", lambda self, x, y, w: fitted.append(len(y)) or plain(self, x, y, w))
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    given = [(i, f"some words of text {i}") for i in ids] + [(ids[0], f"other words {k % 50}") for k in range(500)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    assert score_quality(docs(given), labels).count() == len(given) and fitted == [len(ids)]
