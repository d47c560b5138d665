"""From raw documents to token ids: the stages of a training corpus.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; :func:`run` writes every stage's result as Parquet to the
shared checkpoint folder and hands the reread table to the next one.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, decontam, langid, linededup, ngramjoin
from riskframe.llm.common import shared_table
from riskframe.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a determinable language: no letter at all, or
    a text of some length (``langid.MIN_LETTERS``) that resembles no language
    it was taught (``langid.MIN_SCORE``)."""
    judged = langid.identify(docs, langid.prototypes(docs))
    return judged.where(langid.accepted()).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of every text, whatever its share
    of them; copies made of such lines alone are left to the next stage."""
    return linededup.remove_boilerplate(docs).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates."""
    return ngramjoin.near_duplicates(docs).where("kept").select(*COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source"]).withColumn(
        "n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
    ("clean_of_benchmarks", clean_of_benchmarks), ("encoded", encoded)]

#: Learnt prototypes and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir))
    return docs
