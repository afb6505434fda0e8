"""Counts, breakdowns, samples and self-tests of an index."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import search, semantic, trigrams


def index_stats(files: DataFrame, postings: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One row: num_files, content_bytes, num_trigrams, num_edges, files_with_dependents."""
    out = files.agg(F.count("*").alias("num_files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("content_bytes"))
    grams = postings.agg(F.countDistinct("trigram").alias("num_trigrams")) if postings is not None else None
    links = edges.agg(F.count("*").alias("num_edges"), F.countDistinct("to_id").alias("files_with_dependents")) if edges is not None else None
    for more in (grams, links):
        if more is not None:
            out = out.crossJoin(more)  # of one row each
    return out


def extension_breakdown(files: DataFrame, most: int = 20) -> DataFrame:
    """The extensions with the most files: extension, count, total_bytes."""
    ext = F.lower(paths.extension("path"))
    named = files.select(F.when(ext == "", "(none)").otherwise(ext).alias("extension"), F.octet_length("content").alias("n"))
    return named.groupBy("extension").agg(F.count("*").alias("count"), F.sum("n").alias("total_bytes")).orderBy(F.desc("count"), "extension").limit(most)


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(file_id, symbol_count) with the file's name."""
    return symbols.groupBy("file_id").agg(F.least(F.count("*") + 1, F.lit(65535)).cast("int").alias("symbol_count"))


def sample(files: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """From 1 to 20 files at random, the same ones for a seed."""
    return files.orderBy(F.xxhash64("file_id", F.lit(seed)), "file_id").limit(max(1, min(n, 20)))


def summary(tests: DataFrame) -> DataFrame:
    """Of (passed, duration_ms): total, passed, failed, duration_ms and health."""
    out = tests.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms")).withColumn("failed", F.col("total") - F.col("passed"))
    half = F.floor(F.col("total") / 2)
    return out.withColumn("health", F.when(F.col("failed") == 0, "Healthy").when(F.col("failed") <= half, "Degraded").otherwise("Unhealthy"))


def percentiles(values: DataFrame, value_col: str, of: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles: the value at place n * p / 100, counted from 0."""
    v = values.select(F.col(value_col).alias("v")).filter("v is not null")
    n = v.count()
    if not n:
        return v.agg(*[F.max("v").alias(f"p{p}") for p in of])
    # The first value that so many and a half values reach; counts per value are merged, no sort of all of them.
    return v.agg(*[F.expr(f"percentile_disc({(min(n * p // 100, n - 1) + 0.5) / n!r}d) within group (order by v)").alias(f"p{p}") for p in of])


def lost_files(engine: search.Engine) -> DataFrame:
    """(file_id) of postings of files that aren't there. Each id is looked up once: the postings themselves aren't shuffled."""
    return trigrams.all_files(engine.postings).join(engine.files.select("file_id"), "file_id", "left_anti")


def self_tests(engine: search.Engine) -> DataFrame:
    """(name, passed, duration_ms, message) of the checks that an index answers as it should."""

    def random_file() -> bool:
        row = sample(engine.files, 1).select("file_id", paths.stem("path").alias("s")).first()
        return row is None or engine.by_symbol(row["s"], 1000).filter(F.col("file_id") == row["file_id"]).limit(1).count() == 1

    def content_sample() -> bool:
        row = sample(engine.files.filter("length(content) >= 20"), 1).select("file_id", F.regexp_extract("content", r"([A-Za-z]{4,})", 1).alias("w")).first()
        return row is None or not row["w"] or engine.text(row["w"], 1000).limit(1).count() == 1

    def integrity() -> bool:
        ids = engine.files.agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("d")).first()
        return ids["n"] == ids["d"]

    def trigram_index() -> bool:
        if engine.postings is None:
            return True
        return lost_files(engine).limit(1).count() == 0 and engine.postings.limit(1).count() == min(1, engine.files.limit(1).count())

    def regex() -> bool:
        return engine.regex(r"\w+", 10).count() > 0 or engine.files.limit(1).count() == 0

    tests = {"random_file_search": random_file, "content_sample_search": content_sample, "index_integrity": integrity, "trigram_index": trigram_index, "regex_search": regex}
    return _run(engine.files.sparkSession, tests)


def _run(spark: SparkSession, tests: dict[str, Callable[[], bool]]) -> DataFrame:
    out = []
    for name, test in tests.items():
        began, message = time.time(), ""
        try:
            passed = bool(test())
        except Exception as e:  # noqa: BLE001 - a failed check is a result
            passed, message = False, str(e)[:200]
        out.append((name, passed, int((time.time() - began) * 1000), message))
    return spark.createDataFrame(out, "name string, passed boolean, duration_ms bigint, message string")


def semantic_tests(indexed: DataFrame) -> DataFrame:
    """The same for an index of chunks: encoder, vectors, ids, a search for a chunk's own text, places of chunks."""

    def encoder() -> bool:
        v = semantic.encode("search for some words")
        return len(v) == semantic.DIM and abs(sum(x * x for x in v) - 1) < 1e-6

    def vectors() -> bool:
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        wrong = (F.size("embedding") != semantic.DIM) | ((F.abs(length - 1) > 1e-3) & (length != 0))
        return indexed.filter(F.coalesce(wrong, F.lit(True))).limit(1).count() == 0

    def ids() -> bool:
        r = indexed.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d")).first()
        return r["n"] == r["d"]

    def own_text() -> bool:
        row = indexed.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("text", "embedding").first()
        if row is None or not any(row["embedding"]):
            return True
        return semantic.search(indexed, row["text"], 1).first()["similarity"] > 0.999

    def places() -> bool:
        return indexed.filter("start_line < 1 or end_line < start_line").limit(1).count() == 0

    return _run(indexed.sparkSession, {"encoder": encoder, "vectors": vectors, "chunk_ids": ids, "own_text_search": own_text, "chunk_places": places})


def diagnostics(engine: search.Engine) -> dict[str, DataFrame]:
    tests = self_tests(engine)
    return {"stats": index_stats(engine.files, engine.postings, engine.edges), "extensions": extension_breakdown(engine.files), "tests": tests, "summary": summary(tests)}


def status(engine: search.Engine, indexed: DataFrame | None = None) -> DataFrame:
    """One row: what ``index_stats`` has, the health of the self-tests, and of the chunks, if there are any, their number and health."""
    out = index_stats(engine.files, engine.postings, engine.edges).crossJoin(summary(self_tests(engine)).select("health"))  # of one row each
    if indexed is not None:
        chunks = semantic.stats(indexed).select("num_chunks", F.col("num_files").alias("files_with_chunks"), "dim")
        out = out.crossJoin(chunks).crossJoin(summary(semantic_tests(indexed)).select(F.col("health").alias("semantic_health")))
    return out
