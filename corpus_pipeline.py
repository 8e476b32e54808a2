"""A corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and gives it, read again, to the next. All but the last return the columns of documents,
whatever their names, and empty tables stay empty. Null texts have no words: the quality rules reject them. Texts of any
length are read whole. Of equal or similar documents the one of the least key stays; rows that repeat a key stay or go
together. Documents of null or hot sources are judged like others. The last stage gives one row for each packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, ngram_join, packing, pii, quality_rules
from tessera.llm._shared import Stages, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words a shingle, similarity 0.8 or more."""
    return ngram_join.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("packing", sequences),
]
#: SQL expresses neither the joins' components nor tokens; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, docs = Stages(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return docs
