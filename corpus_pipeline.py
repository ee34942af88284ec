"""From raw documents to packed sequences: language ID, exact and near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of ``documents``; the last one returns
where each piece of a document lies. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, langid, minhash, mixing, packing
from marlstone.llm.common import discard, return_heaps, stage, table

#: Below this posterior no language is believed.
LEAST_SCORE = 0.5
#: Of the words that reach the mixing stage, as many are asked for.
MIX_SHARE = 0.8

#: Language ID, signatures and token ids are not expressible in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, so none with a null, empty or letterless text. Without any labelled document nothing is known, and nothing is rejected."""
    model = langid.learn(docs, F.lit(True))
    if not model.langs:
        return docs
    found = langid.verdict(spark, model, docs["text"])
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LEAST_SCORE))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: shingles of five words, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, each at most once."""
    return mixing.select_documents(docs, MIX_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


def _with_room(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``step`` on executors that don't hold what earlier steps left: their peaks don't add up over the run."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return_heaps(spark)
        return step(spark, docs, sf_dir)

    return run


STAGES = [(step.__name__, _with_room(step)) for step in (language, exact_duplicates, near_duplicates, mix_sources, pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's files are deleted once those of the next one are written; an empty table gives no rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
