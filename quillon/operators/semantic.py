"""Semantic search: chunks of files, hashed bag-of-words vectors, and the nearest chunks by cosine."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.sources import storage

SIZE, OVERLAP, DIM = 50, 5, 128
MOST_RESULTS, MOST_BYTES = 100, 1_000_000
VERSION, DIGITS = 1, 6
_SPLIT = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def chunks_by_size(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(file_id, chunk_no, text, start_line, end_line, chunk_type, symbol_name): windows of lines."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n = F.size("ls")
    rows = files.select("file_id", text.lines("content").alias("ls")).filter(n > 0)
    rows = rows.select("file_id", "ls", F.posexplode(F.sequence(F.lit(1), n, F.lit(size - overlap))).alias("chunk_no", "start_line"))
    body = F.array_join(F.slice("ls", F.col("start_line"), F.lit(size)), "\n")
    end = F.least(F.col("start_line") + size - 1, n)
    return rows.select("file_id", "chunk_no", body.alias("text"), "start_line", end.alias("end_line"), F.lit("Fixed").alias("chunk_type"), F.lit(None).cast("string").alias("symbol_name"))


def chunks_by_symbol(files: DataFrame, symbols: DataFrame, size: int = SIZE) -> DataFrame:
    """One chunk for each symbol, from the line above it."""
    wanted = symbols.filter("symbol_type <> 'FileName'").select("file_id", "name", "symbol_type", "line")
    rows = files.select("file_id", text.lines("content").alias("ls")).join(wanted, "file_id").filter(F.col("line") < F.size("ls"))
    start = F.greatest(F.col("line") - 1, F.lit(0)) + 1
    kind = F.when(F.col("symbol_type").isin("Function", "Method"), "Function").when(F.col("symbol_type").isin("Class", "Type"), "Class").otherwise("Module")
    body = F.array_join(F.slice("ls", start, F.lit(size)), "\n")
    out = rows.select("file_id", "line", body.alias("text"), start.alias("start_line"), F.least(start + size - 1, F.size("ls")).alias("end_line"), kind.alias("chunk_type"), F.when(kind != "Module", F.col("name")).alias("symbol_name"), "name")
    no = F.row_number().over(W.partitionBy("file_id").orderBy("line", "name")) - 1
    return out.withColumn("chunk_no", no).select("file_id", "chunk_no", "text", "start_line", "end_line", "chunk_type", "symbol_name")


def chunks(files: DataFrame, symbols: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """By symbol where a file has any, else by size."""
    if symbols is None:
        return chunks_by_size(files, size, overlap)
    real = symbols.filter("symbol_type <> 'FileName'")
    plain = files.join(real.select("file_id").distinct(), "file_id", "left_anti")
    return chunks_by_symbol(files, real, size).unionByName(chunks_by_size(plain, size, overlap))


class Buckets:
    """Words per bucket of a text. A word's bucket is the sum of its bytes; words are remembered."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim, self.known = dim, {}

    def of(self, text: str) -> np.ndarray:
        known, found = self.known, []
        if len(known) > 500_000:
            known.clear()
        for w in _SPLIT.split(text.lower()):
            k = known.get(w)
            if k is None:
                b = w.encode()
                k = known[w] = sum(b) % self.dim if len(b) > 2 else -1
            if k >= 0:
                found.append(k)
        return np.bincount(np.array(found, dtype=np.int64), minlength=self.dim)

    def vector(self, text: str) -> np.ndarray:
        out = self.of(text).astype(np.float64)
        norm = np.sqrt((out * out).sum())
        return out / norm if norm else out


def encode(query: str, dim: int = DIM) -> list[float]:
    """The vector of a text: words per bucket, scaled to length 1."""
    return Buckets(dim).vector(query).tolist()


def embedded(rows: DataFrame, text_col: str = "text", encoder: Callable[[str], Sequence[float]] | None = None, dim: int = DIM) -> DataFrame:
    """``rows`` with an embedding. Any function from a text to a vector can stand in for the hashed one."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder or Buckets(dim).vector
        for s in parts:
            yield s.map(lambda t: np.asarray(one(t or ""), dtype=np.float32))

    return rows.withColumn("embedding", run(F.col(text_col)))


def bucket_counts(rows: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, bucket, n): the same vectors as rows, before scaling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(dim)
        for b in batches:
            counts = np.array([buckets.of(t or "") for t in b.column(1).to_pylist()]).reshape(-1, dim)
            row, bucket = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(counts[row, bucket])], [id_col, "bucket", "n"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, bucket int, n bigint")


def nearest(vectors: DataFrame, query: Sequence[float], k: int, vec_col: str = "embedding", tie: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """The k rows nearest to a vector by cosine, exactly: one scan and a top-k. Similarities are rounded, so that their order doesn't depend on the order of additions."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", F.round(text.cosine(vec_col, literal), DIGITS)).orderBy(F.desc("similarity"), *tie).limit(k)


def index(files: DataFrame, symbols: DataFrame | None = None, encoder: Callable[[str], Sequence[float]] | None = None) -> DataFrame:
    """The chunks with ids and vectors of all files that aren't too large."""
    small = files.filter(F.octet_length("content") <= MOST_BYTES)
    cut = chunks(small, symbols)
    # An id that is the same in each run: of the file and the place in it, whatever the size of the file's id.
    return embedded(cut.withColumn("chunk_id", F.xxhash64("file_id", "chunk_no").bitwiseAND((1 << 62) - 1)), encoder=encoder)


def save(indexed: DataFrame, folder: str, model: str = "hashed", dim: int = DIM) -> None:
    """Writes an index of chunks as a new version; the manifest comes last."""
    version = f"s-{uuid.uuid4().hex}"
    indexed.write.parquet(f"{folder}/{version}")
    storage.write_text(indexed.sparkSession, f"{folder}/semantic.json", json.dumps({"version": VERSION, "model": model, "dim": dim, "chunks": version}))


def load(spark: SparkSession, folder: str, model: str = "hashed") -> DataFrame:
    """A stored index of chunks; ValueError where its vectors are of another model or version."""
    known = json.loads(spark.read.text(f"{folder}/semantic.json", wholetext=True).first()[0])
    if (known["version"], known["model"]) != (VERSION, model):
        raise ValueError(f"the chunks are of version {known['version']} and model {known['model']}")
    return spark.read.parquet(f"{folder}/{known['chunks']}")


def reload(spark: SparkSession, folder: str, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Builds and stores the chunks of some files anew, and returns them. Who reads the old ones still can."""
    save(index(files, symbols), folder)
    return load(spark, folder)


def search(indexed: DataFrame, query: str, most: int = 20) -> DataFrame:
    """The chunks nearest to a text."""
    if not query.strip():
        return indexed.withColumn("similarity", F.lit(0.0)).limit(0)
    return nearest(indexed, encode(query), max(1, min(most, MOST_RESULTS)), tie=("file_id", "chunk_no"))


class Cache:
    """The results of the last queries, by query and number of results; the least recently used one goes first."""

    def __init__(self, indexed: DataFrame, capacity: int = 100) -> None:
        self.indexed, self.capacity, self.hits, self.misses = indexed, capacity, 0, 0
        self.rows: OrderedDict[tuple[str, int], list[Row]] = OrderedDict()

    def search(self, query: str, most: int = 20) -> list[Row]:
        key = (query.strip(), most)
        if key in self.rows:
            self.hits += 1
            self.rows.move_to_end(key)
        else:
            self.misses += 1
            self.rows[key] = search(self.indexed, query, most).drop("embedding").collect()  # at most MOST_RESULTS rows
            if len(self.rows) > self.capacity:
                self.rows.popitem(last=False)
        return self.rows[key]

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.rows), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def stats(indexed: DataFrame) -> DataFrame:
    """num_chunks, num_files, dim."""
    return indexed.agg(F.count("*").alias("num_chunks"), F.countDistinct("file_id").alias("num_files"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"))


def chunk_types(found: DataFrame) -> DataFrame:
    return found.groupBy("chunk_type").agg(F.count("*").alias("n"))

