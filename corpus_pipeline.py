"""The corpus pipeline: language ID, exact deduplication, near-duplicate join, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of their ``docs``, whatever else those hold and
however it is named, with their values.

Null and empty texts have no letters, so the first stage rejects them; met by a later one (as when stages are run
alone) they are kept: equal to each other in the second, linked with nothing in the third, of size 0 in the fourth
and so not taken, without ids in the fifth. Null ids, languages and sources are values like others. Of rows that
agree in id and text the second stage keeps one. Ties: the smallest id. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.bpe import encode
from kinweave.llm.exact_dedup import ExactDedup
from kinweave.llm.language_id import LanguageId, held_out
from kinweave.llm.mixing import repeated
from kinweave.llm.ngram_join import ShingleJoin
from kinweave.llm.storage import fresh_path

#: Least mean probability of the predicted language; with less, or without a letter, a document goes.
LEAST_SCORE = 0.4


def keeps_columns(*needed: str) -> Callable:
    """For a stage that works on the columns ``needed``: it sees the others under names that clash with none of its own."""

    def wrap(stage):
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            safe = docs.toDF(*(c if c in needed else f"column {k}" for k, c in enumerate(docs.columns)))
            return stage(spark, safe, sf_dir).select(*(f"`{c}`" for c in safe.columns)).toDF(*docs.columns)

        return run

    return wrap


@keeps_columns("doc_id", "text", "lang")
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model recognises; those without a letter go, and so do all if none is labelled."""
    model = LanguageId(docs, train=~held_out(F.col("doc_id")))
    return model.predict(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))


@keeps_columns("doc_id", "text")
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one with the smallest id; one of repeated rows."""
    return ExactDedup(docs).kept()


@keeps_columns("doc_id", "text")
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts: the one with the smallest id. Other texts with that id stay."""
    return ShingleJoin(docs).kept()


@keeps_columns("doc_id", "text", "source")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to 3 times; texts without words aren't taken."""
    return repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, repeats included."""
    return encode(docs.select("doc_id", "text"), digest_only=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mix), ("bpe_encoding", tokens)]

#: A trained model decides in the first stage; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
