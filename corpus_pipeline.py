"""Documents to training data: five stages, each one operator over all that is left.

Language ID (documents without a known language go), line dedup (later copies of lines
go, and documents left without any), n-gram Jaccard join (one document of each group
stays), benchmark decontamination (documents that repeat an item go), byte-level BPE.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from closeline import session
from closeline.llm import bpe, decontamination, language, lines, partenum
from closeline.llm.queries import query
from closeline.llm.texts import table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenise),
]

ORACLE_SQL = None  # a trained model and SimHash candidates have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared checkpoint folder and read again."""
    folder = posixpath.join(session.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
