"""The cleaning of a corpus, from documents to packed bins.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet into the folder that all executors share and reads again as the next stage's docs. All but the last stage return
the columns of ``documents``.

SQL can't express the first and the last two stages (decoding under a language model, transitive groups, packing), so
``ORACLE_SQL`` is None; tests hold the run against brute-force versions.

Defined results: null texts, and texts without a good line, go with the quality rules; documents with null ids go through all stages and are never near copies;
repeated rows stay or go together; further columns, whatever their names, come as far as the last stage; empty tables give no rows; without
labels nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import jaccard, linededup, packing, quality, toxicity
from quillon.llm.common import written


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity of the restored text; documents that it rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def poor_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules line by line; documents that lose too much go."""
    return quality.clean(docs)


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words and chunks of lines that occur before, anywhere in the corpus, go."""
    return linededup.dedup(docs)


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def pack_into_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, goes."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents_go),
    ("quality rules", poor_documents_go),
    ("line dedup", repeated_lines_go),
    ("n-gram Jaccard join", near_copies_go),
    ("best-fit packing", pack_into_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
