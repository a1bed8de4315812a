"""A training-data pipeline: documents to packed sequences, each stage over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table
from larkspur.llm.line_dedup import line_dedup
from larkspur.llm.near_copies import similar_dedup
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality_classifier import quality_model, scored
from larkspur.llm.substring_dedup import substring_dedup
from larkspur.sources.shared import own_path, remove_path, temporary

#: A score from here on is predicted as good, as in the classifier's own query.
GOOD = 0.3
BESIDES = ("lang", "source")


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, rejects go.

    Null and empty texts are scored as empty ones, so these stay or go together, as equal texts do; null doc_ids have
    no label. Repeated rows are scored each on its own. Columns other than those of documents, whatever their names,
    stay behind; so they do in all stages. An empty table gives no rows, here and in all stages.
    """
    docs = docs.select(*COLUMNS)
    return scored(docs, quality_model(docs, table(spark, sf_dir, "labels")), score_col="_score").where(F.col("_score") >= GOOD).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, alone or in runs, go from the texts; n_chars is counted anew.

    No document goes. Null texts stay null (n_chars 0), empty ones empty; a null doc_id is later than all others; of
    rows equal in doc_id and text none repeats the other. Texts of any length are read whole.
    """
    return _documents(line_dedup(docs, keep=BESIDES))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its 5-word shingles stays, that of the smallest doc_id.

    Null texts, empty ones and those without a word are one group; a null doc_id is behind all others. Rows equal in
    doc_id and text are one document; rows that share a doc_id alone stay or go together.
    """
    return similar_dedup(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 20-word passages that start earlier go from the texts; n_chars is counted anew.

    No document goes. Nulls, empty texts, repeated rows and ids as in lines.
    """
    return _documents(substring_dedup(docs, keep=BESIDES))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens.

    Null and empty texts are the end token alone; repeated rows are packed each on its own.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("substrings", substrings), ("packing", packing)]

#: SQL can't express a trained network; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows are written to the shared folder and read again.

    What a stage needed beside its rows goes when these are written, and the rows before them too.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = own_path(spark, f"pipeline-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
