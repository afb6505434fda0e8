"""Files as a table: discovery, character sets, the safety gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths

MOST_BYTES = 10 * 1024 * 1024
CHECKED, LONGEST_LINE, DEEPEST = 8192, 100_000, 500


def discover(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = (), extensions: Sequence[str] = (), binary: Sequence[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of the regular files under some roots.

    Excluded globs, files of other extensions (where some are given), of binary extensions and larger than the limit are left out;
    the filters on path and length reach the scan, so such files are not read. Empty files have no line to find and no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    found = found.filter((F.col("length") <= most_bytes) & ~paths.has_binary_extension("path", binary))
    if extensions:
        found = found.filter(F.lower(paths.extension("path")).isin([x.lower().lstrip(".") for x in extensions]))
    if exclude:
        found = found.filter(paths.selected("path", None, exclude))
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def without(files: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """``files`` less those of exactly these paths."""
    names = [x.replace("\\", "/") for x in excluded]
    return files.filter(~paths.slashes("path").isin(names)) if names else files


def is_binary(raw: bytes) -> bool:
    """By the first bytes: a NUL, or more than a tenth of control characters."""
    head = np.frombuffer(raw[:CHECKED], dtype=np.uint8)
    control = (head < 32) & (head != 9) & (head != 10) & (head != 13)
    return bool((head == 0).any() or int(control.sum()) > len(head) // 10)


def depth(text: bytes) -> int:
    """How deep brackets are nested; a closing one that is too many doesn't count."""
    b = np.frombuffer(text, dtype=np.uint8)
    step = np.isin(b, list(b"{([")).astype(np.int64) - np.isin(b, list(b"})]"))
    if not len(step):
        return 0
    level = np.cumsum(step)
    return int((level - np.minimum(np.minimum.accumulate(level), 0)).max(initial=0))


def unsafe(text: str) -> str | None:
    """Why a text is not indexed; null if it is."""
    raw = text.encode()
    if is_binary(raw):
        return "binary content"
    if max(map(len, raw.split(b"\n"))) > LONGEST_LINE:
        return "line too long"
    return "nested too deeply" if depth(raw) > DEEPEST else None


def decoded(raw: bytes) -> tuple[str, str] | None:
    """(text, encoding) of a file's bytes; null where it is no text.

    Byte order marks first, then UTF-8, then a guess: Shift-JIS where all bytes fit and some are of two bytes, else Windows-1252.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            text = raw[len(mark) :].decode(name, errors="replace")
            return None if "�" in text or is_binary(text.encode()) else (text, name)
    try:
        text = raw.decode()
        return None if is_binary(raw) else (text, "utf-8")
    except UnicodeDecodeError:
        pass
    if is_binary(raw):
        return None
    for name in ("shift_jis", "cp1252", "latin-1"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if name == "shift_jis":
            kana = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in text)
            if 2 * kana < sum(c > "\x7f" for c in text) or any("｡" <= c <= "ﾟ" for c in text):
                continue
        return text, name
    return None


def prepared(raw: DataFrame, transcode: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(path, content, encoding, reason), and columns to keep: the text of each file, or the reason why it has none."""

    def one(data: bytes) -> tuple[str | None, str | None, str | None]:
        got = decoded(data)
        if got is None:
            return None, None, "no text"
        if got[1] != "utf-8" and not transcode:
            return None, got[1], "not UTF-8"
        why = unsafe(got[0])
        return (None, got[1], why) if why else (got[0], got[1], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(x or b"") for x in b.column(1).to_pylist()]
            kept = [b.column(2 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m[i] for m in made], pa.string()) for i in range(3)], *kept], ["path", "content", "encoding", "reason", *keep])

    kinds = "".join(f", `{c}` {raw.schema[c].dataType.simpleString()}" for c in keep)
    return raw.select("path", "content", *keep).mapInArrow(run, "path string, content string, encoding string, reason string" + kinds)


def gate(files: DataFrame, text_col: str = "content") -> DataFrame:
    """``files`` with the reason why a text is not safe to index, null where it is."""

    @F.pandas_udf("string")
    def why(s):
        return s.map(lambda t: unsafe(t) if t is not None else None)

    return files.withColumn("reason", why(F.col(text_col)))


def longest_line(content: Column | str) -> Column:
    """Bytes of the longest line."""
    c = F.col(content) if isinstance(content, str) else content
    return F.array_max(F.transform(F.split(c, "\n", -1), F.octet_length))


def numbered(files: DataFrame) -> DataFrame:
    """``files`` with ids that are the same in each run: a hash of the path, not the order of arrival."""
    return files.withColumn("file_id", F.xxhash64("path").bitwiseAND((1 << 62) - 1))


def load(spark: SparkSession, roots: Sequence[str], **options) -> DataFrame:
    """(file_id, path, content) of the text files under some roots."""
    return numbered(prepared(discover(spark, roots, **options)).filter("reason is null").select("path", "content")).select("file_id", "path", "content")
