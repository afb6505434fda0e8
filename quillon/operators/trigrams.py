"""Byte trigrams, postings and candidates.

A posting list is a set of rows (trigram, file_id); where it is stored, ``lists`` of files that are sorted by trigram within segments, so that building
it needs no shuffle and a lookup reads a few pages of each segment; ``bitmaps`` is the compact form. Trigrams are of the text in lower case and of the file's stem, extracted apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import paths

LEAST = 3
#: Bytes of text that are cut into trigrams at once, and postings of a segment.
AT_ONCE, SEGMENT = 1 << 20, 1 << 21


def of(text: str) -> list[int]:
    """The different trigrams of a text's bytes, as 24-bit numbers."""
    b = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int32)
    return np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]).tolist() if len(b) >= 3 else []


def _keys(texts: pa.Array, first: int) -> Iterator[np.ndarray]:
    """The trigrams of some texts with the numbers of the texts, counted from ``first``, as trigram << 32 | number; long texts come in parts."""
    raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    for low in range(ends[0], ends[-1] - 2, AT_ONCE):
        parts = np.clip(ends, low, low + AT_ONCE + 2)  # two bytes more: a trigram begins at each of AT_ONCE bytes
        b = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[low : parts[-1]].astype(np.int64)
        owner = np.repeat(np.arange(first, first + len(raw)), np.diff(parts))
        yield _each_once([((b[:-2] << 48) | (b[1:-1] << 40) | (b[2:] << 32) | owner[2:])[owner[:-2] == owner[2:]]])


def _each_once(keys: list[np.ndarray]) -> np.ndarray:
    """The different keys, in order."""
    all_keys = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
    all_keys.sort()
    return all_keys[np.diff(all_keys, prepend=-1) != 0]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(keys, file ids) of batches of (file_id, content, stem): the keys are different and sorted, their numbers are places in the ids.

    All keys of a file are in one segment. Texts are cut into trigrams by parts of ``AT_ONCE`` bytes, and a segment ends with the text that brings it to
    ``SEGMENT`` keys, so the memory is bounded.
    """
    keys, ids, known, count = [], [], 0, 0
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
            keys.append(_each_once([k for c in (1, 2) for k in _keys(b.column(c).slice(at, end - at), known)]))
            ids.append(b.column(0).slice(at, end - at))
            known, count, at = known + end - at, count + len(keys[-1]), end
            if count >= SEGMENT:
                yield _each_once(keys), pa.concat_arrays(ids)
                keys, ids, known, count = [], [], 0, 0
    if ids:
        yield _each_once(keys), pa.concat_arrays(ids)


def _lowered(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.lower("content").alias("content"), F.lower(paths.stem("path")).alias("stem"))


def postings(files: DataFrame) -> DataFrame:
    """(trigram, file_id) of each file's content and stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _segments(batches):
            for i in range(0, len(keys), 1 << 16):
                some = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((some >> 32).astype(np.int32)), ids.take(pa.array(some & 0xFFFFFFFF))], ["trigram", "file_id"])

    return _lowered(files).mapInArrow(run, "trigram int, file_id bigint")


def lists(files: DataFrame) -> DataFrame:
    """(trigram, file_ids): the same as lists. A task makes segments of some thousand files each; within one, a trigram has one row and trigrams ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _segments(batches):
            grams = (keys >> 32).astype(np.int32)
            starts = np.flatnonzero(np.diff(grams, prepend=-1))
            whole = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), ids.take(pa.array(keys & 0xFFFFFFFF)))
            for i in range(0, len(starts), 1 << 12):
                yield pa.RecordBatch.from_arrays([pa.array(grams[starts[i : i + (1 << 12)]]), whole.slice(i, 1 << 12)], ["trigram", "file_ids"])

    return _lowered(files).mapInArrow(run, "trigram int, file_ids array<bigint>")


def of_lists(packed: DataFrame) -> DataFrame:
    """(trigram, file_id) of ``lists``. A filter on trigrams reaches the scan."""
    return packed.select("trigram", F.explode("file_ids").alias("file_id"))


def frequencies(posts: DataFrame) -> DataFrame:
    """(trigram, df)"""
    return posts.groupBy("trigram").agg(F.count("*").alias("df"))


def dense(ids: DataFrame, share: int = 1 << 20) -> DataFrame:
    """(file_id, number): the different ids numbered from 1 without gaps, for bitmaps (number 0 would have a bucket of its own).

    Ids are numbered within shares of about a million by hash; only the sizes of the shares go to the driver.
    """
    ids = ids.select("file_id").distinct()
    parts = max(1, -(-ids.count() // share))
    ids = ids.withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(parts)))
    sizes, first = {r["part"]: r["count"] for r in ids.groupBy("part").count().collect()}, [0]
    for k in range(parts):
        first.append(first[-1] + sizes.get(k, 0))
    offsets = ids.sparkSession.createDataFrame(list(enumerate(first[:-1])), "part bigint, first bigint")
    place = F.row_number().over(W.partitionBy("part").orderBy("file_id")) - 1
    return ids.withColumn("place", place).join(F.broadcast(offsets), "part").select("file_id", (F.col("first") + F.col("place") + 1).alias("number"))


def bitmaps(posts: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(trigram, bucket, bitmap, df): a bitmap of the ids of each range of ids. numbers (``dense``): of ids that are spread out, such as hashes."""
    if numbers is not None:
        posts = posts.join(numbers, "file_id").select("trigram", F.col("number").alias("file_id"))
    grouped = posts.groupBy("trigram", F.bitmap_bucket_number("file_id").alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("bitmap"), F.count("*").alias("df"))


def all_files(posts: DataFrame) -> DataFrame:
    """Files with any trigram."""
    return posts.select("file_id").distinct()


def usable(texts: Sequence[str]) -> bool:
    """Whether postings can tell the files that may have one of the texts: each is long enough for a trigram."""
    return bool(texts) and all(len(t.encode()) >= LEAST for t in texts)


def candidates(posts: DataFrame, texts: list[str]) -> DataFrame:
    """(file_id) of the files that have all trigrams of one of the texts (in lower case); all files where a text is too short for one."""
    if not usable(texts):
        return all_files(posts)
    wanted = [of(t) for t in texts]
    found = None
    for grams in wanted:
        have = posts.filter(F.col("trigram").isin(grams)).groupBy("file_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("file_id")
        found = have if found is None else found.union(have)
    return found if len(wanted) == 1 else found.distinct()


def bitmap_candidates(maps: DataFrame, text: str) -> DataFrame:
    """(bucket, bitmap): the intersection of the bitmaps of a text's trigrams."""
    grams = of(text)
    return maps.filter(F.col("trigram").isin(grams)).groupBy("bucket").agg(F.expr("bitmap_and_agg(bitmap)").alias("bitmap"), F.count("*").alias("n")).filter(F.col("n") == len(grams)).drop("n")
