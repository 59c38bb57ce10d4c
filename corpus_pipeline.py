"""From raw documents to a training mixture: five stages over the columns of documents.

1. language: documents whose language the model does not know go.
2. lines: lines that occur in many documents go from all of them.
3. near duplicates: one document of each class of similar texts stays.
4. leaks: documents that hold words of the benchmark go.
5. mixture: documents are repeated or left out until sources meet their target weights.

Every stage is written as Parquet to the shared folder and read again by the next one.
Columns besides those of documents are left out; nulls, empty texts, repeated rows and
empty tables are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.llm import decontaminate, language, line_dedup, mixing, ngram_join
from logdistill.llm.common import DOCUMENT_COLUMNS, documents_of, stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(documents_of(docs))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean = line_dedup.dedup_lines(documents_of(docs))
    # The length follows the text where lines were dropped.
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return lean.withColumn("n_chars", length).select(*DOCUMENT_COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(documents_of(docs))


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents_of(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*DOCUMENT_COLUMNS)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``copy``, the number of the repetition from 1."""
    return mixing.mix(documents_of(docs)).select(*DOCUMENT_COLUMNS, "copy")


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("leaks", leaks_stage),
    ("mixture", mixture_stage),
]

# A learned model and randomised joins decide what stays, so SQL cannot say it; the tests
# hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
