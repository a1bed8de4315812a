"""Quality rules that vote or abstain, weighed by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from larkspur.llm.common import cut, documents
from larkspur.llm.windows import window_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LOWER_OR_BEYOND = LOWER + bytes(range(128, 256))
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_ended")
ROUNDS = 40
#: See weigh().
TRUST = 0.05


def repeat_words(words: list[bytes], size: int) -> int:
    """Words in windows of size words that the text has twice or more."""
    if len(words) <= size:
        return 0
    units = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    keys = window_hashes(units, size)
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(body: bytes) -> tuple[int, ...]:
    """The figures in NAMES of one text."""
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.translate(None, SPACE)]
    dense = body.translate(None, SPACE)
    lost = lambda chars: len(dense) - len(dense.translate(None, chars))
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return len(words), len(dense.decode("utf-8", "replace")), lost(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words, 5), len(lines), lost(UPPER), lost(LOWER_OR_BEYOND), ended


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the figures in NAMES (long); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[measure(b or b"") for b in batch["body"].to_pylist()])) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *NAMES])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def votes() -> dict[str, Column]:
    """0: bad, 1: abstains, 2: good. Shares are of words, lines or letters; integers, so that ties are exact."""
    c = F.col
    letters, never = c("n_upper") + c("n_lower"), F.lit(False)
    return {
        "v_word_size": _vote((2 * c("word_chars") < 5 * c("n_words")) | (c("word_chars") > 13 * c("n_words")), never),
        "v_symbols": _vote(10 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        "v_lines": _vote(2 * c("n_dup_lines") > c("n_lines"), never),
        "v_capitals": _vote(2 * c("n_upper") > letters, never),
        "v_letters": _vote(2 * letters < c("word_chars"), never),
        "v_ended": _vote((c("n_ended") == 0) & (c("n_lines") > 2), 2 * c("n_ended") >= c("n_lines")),
    }


def weigh(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of good texts, and P(vote | class) as [class, rule, vote], for vote patterns that occur so many times.

    Two latent classes, votes independent within a class. The start takes a bad vote as a sign of a bad text. What is
    known of the rules beforehand holds each round: a good text gets a rule's bad vote at most TRUST times as often
    as a bad one, and its good vote no less often.
    """
    rules = patterns.shape[1]
    good = np.where((patterns == 0).any(axis=1), 0.1, 0.9)
    share, rates = 0.5, np.zeros((2, rules, 3))
    for _ in range(ROUNDS):
        share = float((counts @ good + 1) / (counts.sum() + 2))
        for k, weight in enumerate((counts * (1 - good), counts * good)):
            for v in range(3):
                rates[k, :, v] = (weight @ (patterns == v) + 0.5) / (weight.sum() + 1.5)
        rates[1, :, 0] = np.minimum(rates[1, :, 0], TRUST * rates[0, :, 0])
        rates[0, :, 2] = np.minimum(rates[0, :, 2], rates[1, :, 2])
        rates[:, :, 1] = 1 - rates[:, :, 0] - rates[:, :, 2]
        good = posterior(patterns, share, rates)
    return share, rates


def posterior(patterns: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    rule = np.arange(patterns.shape[1])
    logs = np.log(rates)[:, rule, patterns].sum(axis=2)
    return 1 / (1 + np.exp(np.clip(np.log(1 - share) + logs[0] - np.log(share) - logs[1], -500, 500)))


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the figures in NAMES, a column for each vote, base_failed, posterior (probability of good), kept.

    base_failed: under 10 words, or over 20 % of the words repeat in 5-word windows; such rows are never kept. The
    others are kept if their posterior reaches threshold. Votes of all rows enter the estimate, as counts of vote
    patterns (at most three to the power of the number of rules), so one row for each reaches the driver.

    Null and empty texts fail the base; texts of any length are read whole; null doc_ids stay null. Repeated rows count
    and are judged each on its own, and equal texts alike; a posterior at the threshold is kept. Columns other than the
    two named stay behind, whatever their names. An empty table gives no rows. The figures are written once and read
    twice.
    """
    rules = votes()
    rows = cut(measured(docs, id_col, text_col).withColumns(rules))
    found = rows.groupBy(*rules).count().collect()
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    if not found:
        return rows.withColumns({"posterior": F.lit(0.0), "kept": F.lit(False)})
    patterns = np.array([r[:-1] for r in found], int)
    chances = posterior(patterns, *weigh(patterns, np.array([r["count"] for r in found], float)))
    known = docs.sparkSession.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, chances)], ", ".join(f"{n} int" for n in rules) + ", posterior double")
    return rows.join(F.broadcast(known), list(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
