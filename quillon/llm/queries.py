"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import ann, bpe, htmlcut, jaccard, licenses, linededup, packing, quality, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenised(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.bundled(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 100, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_bpe": op2_bpe,
        "op3_html_extraction": op3_html_extraction,
        "op4_line_dedup": op4_line_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_warc_bundles": op6_warc_bundles,
        "op7_quality_rules": op7_quality_rules,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": linededup.sql(),
        "op7_quality_rules": quality.sql(),
        "op9_ngram_jaccard_join": jaccard.sql(),
    }
