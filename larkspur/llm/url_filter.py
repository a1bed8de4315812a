"""URL filter: rules on host and path, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mix

#: Fixed values: (host suffix, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: What the labelled URLs are made of: words that public block lists' categories are named after (advertising, adult,
#: gambling, medicines, piracy, malware, loans, fakes, spam), and words of everyday sites. Chosen without a look at any table.
BAD = (
    "adserver adclick banners popunder tracking telemetry clicks affiliate adult porn xxx erotic escort webcams hookup casino gambling poker jackpot roulette slots betting bets lottery "
    "pills viagra pharmacy meds steroids warez cracked keygen torrents piracy malware phishing spyware trojan payday loans credit replica counterfeit spam clickbait linkfarm followers giveaway prizes winner"
).split()
GOOD = (
    "library university school museum garden weather recipes history science travel music theatre forum health council railway mountain painting chess farmers market book club open data river language poetry "
    "news letters kitchen sports hiking cycling maps energy housing software physics biology archive film photo church parish village harbour island bakery coffee wine tea design studio legal tax insurance"
).split()
#: Words that go with either kind, so that they tell nothing.
EITHER = "my the best top online shop web site world free now daily info live pro net plus home".split()
CONSONANTS, VOWELS = "b c d f g h j k l m n p r s t v w z ch sh th st tr br pl gr nd".split(), "a e i o u ai ea ou io".split()
FRONTS, ENDS, PATHS = ("", "www.", "m.", "blog."), ("com", "net", "org", "info", "example.com", "example.org"), ("", "/", "/en/101.html", "/de/7", "/fr/52/", "/es/9", "/page", "/a/b.php")

SLOTS, GRAMS, ROUNDS, RATE, DECAY = 1 << 13, (3, 4, 5), 800, 60.0, 1e-5
#: Bytes of URLs that are scored at a time.
AT_ONCE = 1 << 20


def _made_up(draw: random.Random) -> str:
    """A name without meaning, by syllables: such names are no reason to block."""
    name = "".join(draw.choice(CONSONANTS) + draw.choice(VOWELS) for _ in range(draw.randrange(1, 4)))
    return draw.choice(["", draw.choice(VOWELS)]) + name + draw.choice(["", draw.choice(CONSONANTS)])


def labelled(seed: int = 7, rows: int = 1200) -> list[tuple[str, str, int]]:
    """The small labelled table: host, path, 1 for block. Drawn by a rule from the word lists above.

    A bad name has a word of BAD, alone or beside a word of any other kind; a good one has none. Fronts, ends, paths
    and the words of EITHER are dealt alike to both kinds, so they tell nothing; no host is no reason to block.
    """
    draw, out = random.Random(seed), [("", "", 0)] * 4
    for i in range(rows):
        other = lambda: draw.choice([draw.choice(GOOD), draw.choice(EITHER), _made_up(draw), _made_up(draw)])
        bad = i % 3 == 0
        words = [draw.choice(BAD) if bad else draw.choice([draw.choice(GOOD), _made_up(draw)])]
        words += [draw.choice(BAD) if bad and draw.random() < 0.3 else other() for _ in range(draw.randrange(0, 2))]
        draw.shuffle(words)
        out.append((draw.choice(FRONTS) + draw.choice(["-", "-", ""]).join(words) + "." + draw.choice(ENDS), draw.choice(PATHS), int(bad)))
    return out


def _grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashed n-grams of ^text$, and the text each is of. Digits 1 to 9 count as 0, as numbers mean nothing."""
    bodies = [b"^" + t.encode("utf-8", "replace") + b"$" for t in texts]
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    data = np.where((data >= 49) & (data <= 57), 48, data).astype(np.uint64)
    owner, slots, owners = np.repeat(np.arange(len(texts)), size), [], []
    for n in GRAMS:
        if len(data) >= n:
            at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            key = np.full(len(at), salt * 16 + n, np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | data[at + k]
            slots.append((mix(key) % np.uint64(SLOTS)).astype(np.int64))
            owners.append(owner[at])
    return np.concatenate(slots) if slots else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all n-grams of host and path, the row of each, and its value there: a row has length 1 but for repeats."""
    parts = _grams(hosts, 1), _grams([p.lower() for p in paths], 2)
    slot, row = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return slot, row, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))[row]


class UrlModel:
    """Logistic regression over pooled hashed n-grams, fitted by full-batch gradient descent."""

    def __init__(self, rows: list[tuple[str, str, int]] | None = None):
        rows = labelled() if rows is None else rows
        slot, row, value = features([r[0] for r in rows], [r[1] for r in rows])
        y = np.array([r[2] for r in rows], float)
        self.weights, self.bias = np.zeros(SLOTS), 0.0
        for _ in range(ROUNDS):
            error = 1 / (1 + np.exp(-(np.bincount(row, self.weights[slot] * value, len(y)) + self.bias))) - y
            self.weights -= RATE * (np.bincount(slot, error[row] * value, SLOTS) / len(y) + DECAY * self.weights)
            self.bias -= RATE / 10 * error.mean()

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probabilities of block, a bounded number of bytes at a time."""
        out, start, size = [], 0, 0
        for i, (h, p) in enumerate(zip(hosts, paths)):
            size += len(h) + len(p)
            if size >= AT_ONCE or i + 1 == len(hosts):
                slot, row, value = features(hosts[start : i + 1], paths[start : i + 1])
                total = np.bincount(row, self.weights[slot] * value, i + 1 - start)
                out.append(1 / (1 + np.exp(-(total + self.bias))))
                start, size = i + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


@lru_cache(maxsize=1)
def own_model() -> UrlModel:
    return UrlModel()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without '://'."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def _fits(rule: tuple[str, str, str]) -> Column:
    name, start, _ = rule
    return ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score, one row per row of pages. No shuffle.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (characters of host
    and path) wins, the first of equally long ones. Without a rule the model decides: block from threshold on; score is
    null where a rule did. Null and empty urls and those without '://' have empty host and path and are scored as such;
    null page_ids stay null. Urls of any length are scored whole. Repeated rows are judged alike, each on its own; equal
    urls have equal verdicts. Further columns stay behind, whatever their names; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        best = F.when(_fits(rule), rule[0] + rule[1]).otherwise(best)
        verdict = F.when(_fits(rule), rule[2]).otherwise(verdict)

    sent = pages.sparkSession.sparkContext.broadcast(own_model())  # SLOTS weights

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = sent.value
        for hosts, paths in batches:
            at = np.flatnonzero(hosts.notna().to_numpy())
            pairs = list(zip(hosts.iloc[at], paths.iloc[at]))
            place = {p: i for i, p in enumerate(dict.fromkeys(pairs))}  # equal urls are scored once a batch
            found = model.scores([h for h, _ in place], [p for _, p in place])
            out = np.full(len(hosts), np.nan)
            out[at] = found[[place[p] for p in pairs]] if pairs else []
            yield pd.Series(out)

    open_ = F.col("_ruled").isNull()
    score = F.pandas_udf(scored, "double")(F.when(open_, F.col("host")), F.when(open_, F.col("path")))
    out = rows.withColumns({"rule": best, "_ruled": verdict}).withColumn("score", score)
    verdict = F.coalesce("_ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(open_, F.col("score")).alias("score"))
