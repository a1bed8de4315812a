import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

#: Column names that operators use inside, on tables that happen to have them too.
CLASHES = "size shard slot body digest points keep_id fp bucket kind blob score n_words length rank _task _rank _first label pooled".split()


@pytest.fixture
def docs(spark):
    """Makes a table of (doc_id, text) rows, with every clashing name as one more column."""

    def make(rows, clash=True):
        if not clash:
            return spark.createDataFrame(rows, DOCS)
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in CLASHES]])
        return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema)

    return make


ODD = [
    (1, "a plain text of some words that is long enough to be split into windows of twenty words, and then some more words follow it here."),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r"),
    (5, "word"),
    (None, "a text without an id"),
    (None, None),
    (6, "line one\nline two\nline three\n\nline one\nline two"),
    (7, "line one\nline two\nsomething else"),
    (7, "line one\nline two\nsomething else"),
    (8, "é漢🜁 " * 30),
    (9, "x" * 200_000),
    (10, "the same words again and again " * 400),
    (11, "\x00 nul and \ufffd \u2028 separators \x85 here"),
    (12, "A Plain"),
]


@pytest.fixture
def odd():
    return list(ODD)
