"""Corpus pipeline: documents in, a mixed training corpus out, stage by stage.

Every stage works on all that the stage before it kept and returns the columns of documents;
each result is written as Parquet and read again as the next stage's documents. The last stage
repeats rows as often as the mix takes them.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and
further columns of any name, and says below what becomes of them; columns pass through as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterwise.llm import language_id, line_dedup, ngram_join, pivotal_mix, suffix_arrays
from meterwise.llm.scratch import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and the few short ones where no language is likelier than
    all others together; gibberish and languages not learned stay. Learns from the labelled
    languages of the documents given (none: all go). Null, empty and letterless texts go; repeated
    rows fare alike; an empty table stays empty."""
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat an earlier line, and documents that lose all their words so. Equal rows
    (id and text) are one document and lose the same lines; null and wordless texts have no line to
    lose and stay; ``n_chars`` is brought up to date; lines of any length are read whole."""
    return line_dedup.clean(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by shingles: that with the smallest id, of repeated
    rows one. Null and wordless texts link with nothing and all stay; null ids never group texts."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages. Null and wordless texts stay; repeated rows fare
    alike; null and wordless items match nothing, and without items all documents stay."""
    return suffix_arrays.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every source to its share of the words; a row per copy taken. A null source is a source
    (the last); wordless texts are never taken; the draw goes by id, size and text, so that equal
    rows are drawn alike in any order of arrival."""
    return pivotal_mix.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

# Trained models and random rounding have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
