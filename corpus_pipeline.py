"""The corpus pipeline: quality, near-dedup, decontamination, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.  What nulls,
empty and very long texts, ties, repeated rows, empty tables and extra columns
give is what the stages' operators state; all stages take each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import decontamination, mixing, near_dedup, quality, token_files
from pricewright.llm.queries import table, tokenizer
from pricewright.llm.shared import remove, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return near_dedup.distinct_documents(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or cut so that their sources come to the target weights."""
    return mixing.mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as token ids in compressed files; a row per document read back from them."""
    return token_files.write_and_read(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SQL cannot express near-duplicates by banding or the library's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if name != STAGES[0][0]:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
