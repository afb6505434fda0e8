"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames of about ``frame_bytes`` that are compressed independently of each other. A bundle is a file of
frames and, at its end, a seek table: a skippable frame with the compressed and the full size of each frame, as the seekable
Zstandard format has it, so that other readers can use it and a plain decompressor passes over it. The index tells for each
record its bundle, its frame and its offset within the frame; a record is read from the seek table and one frame.

Each task writes the bundles of its rows, under the name of its partition, first to a name of the attempt and then moved. A task
that is run again writes the same bytes in the same place, so lost executors and second attempts do no harm. No shuffle.

Defined results: a null page is a record without content, that reads as null (a header says so), an empty page one of
length 0; repeated rows are records of their own with the same record id; null ids and urls are kept as such; an empty table
gives an empty index and no bundle. A record that is longer than a frame has a frame to itself. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField

from quillon.llm.common import free, map_rows, quoted, removed_at_exit, written
from quillon.sources.storage import shared_dir

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
#: There is no time of retrieval in the table.
DATE = "1970-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NULL = "X-Null-Content: true"
INDEX = "record_id string, bundle string, frame int, frame_begin bigint, frame_size int, begin int, size int"


def record_id(page_id: object, url: str | None, content: bytes | None) -> str:
    """The same for equal rows."""
    digest = hashlib.sha1(content).hexdigest() if content is not None else "null"
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id!r} {url!r} {digest}')}"


def record(name: str, url: str | None, content: bytes | None, date: str = DATE) -> bytes:
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if content is None:
        head.append(_NULL)
    body = content or b""
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def content(raw: bytes) -> bytes | None:
    """What a record holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    if _NULL in lines:
        return None
    size = next(int(x.partition(":")[2]) for x in lines if x.startswith("Content-Length:"))
    return rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of so many compressed and full bytes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, _SEEKABLE)


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(begin, compressed size, full size) of each frame of a bundle."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 128 else 8
    file.seek(end - 9 - count * width)
    raw, out, at = file.read(count * width), [], 0
    for i in range(count):
        packed, full = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, full))
        at += packed
    return out


class Bundle:
    """A bundle that is being written."""

    def __init__(self, folder: str, name: str, attempt: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.temp = name, f"{self.root}/.{name}.{attempt}"
        self.fs.create_dir(self.root, recursive=True)
        self.file = self.fs.open_output_stream(self.temp)
        self.frames: list[tuple[int, int]] = []
        self.at = 0

    def frame(self, raw: bytes, level: int) -> tuple[int, int, int]:
        """Adds a frame: its number, where it begins, and its size."""
        packed = zstandard.ZstdCompressor(level=level, write_checksum=True).compress(raw)
        self.file.write(packed)
        self.frames.append((len(packed), len(raw)))
        begin, self.at = self.at, self.at + len(packed)
        return len(self.frames) - 1, begin, len(packed)

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", content_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Writes bundles into a folder that all executors reach and returns the index, which is written too."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt, number = task.partitionId(), str(task.taskAttemptId()), 0
        bundle, waiting, rows, size = None, [], [], 0

        def flush() -> list[tuple]:
            """The waiting records become a frame."""
            nonlocal bundle, waiting, rows, size, number
            if bundle is None:
                bundle = Bundle(folder, f"part-{part:06d}-{number:04d}.warc.zst", attempt)
            found = (*bundle.frame(b"".join(waiting), level),)
            out = [(i, name, bundle.name, *found, begin, n) for i, name, begin, n in rows]
            waiting, rows, size = [], [], 0
            if bundle.at >= bundle_bytes:
                bundle.close()
                bundle, number = None, number + 1
            return out

        done: list[tuple] = []
        for b in batches:
            for i, url, raw in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                body = raw.as_py()
                body = body.encode() if isinstance(body, str) else body
                name = record_id(i.as_py(), url, body)
                made = record(name, url, body, date)
                if size and size + len(made) > frame_bytes:
                    done += flush()
                rows.append((i, name, size, len(made)))
                waiting.append(made)
                size += len(made)
        if waiting:
            done += flush()
        if bundle is not None:
            bundle.close()
        # Rows of the index leave when all bundles of the task are in place.
        names = ["id", *[x.split()[0] for x in INDEX.split(", ")]]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        columns = list(zip(*done)) if done else [[]] * 8
        ids = pa.array([x.as_py() for x in columns[0]], columns[0][0].type) if done else None
        if done:
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names)

    only = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), quoted(content_col).alias("content"))
    return written(only.mapInArrow(run, f"id {kind}, {INDEX}"), "index").withColumnRenamed("id", "page_id")


def read(index: DataFrame, folder: str, content_col: str = "html") -> DataFrame:
    """``index`` with the content of each of its records. Rows of a frame are brought together, so a frame is read once."""
    (name,) = free(index, content_col)
    fields = index.columns
    at = [fields.index(x) for x in ("bundle", "frame", "begin", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        tables: dict[str, list] = {}
        opened, frame = (None, None), b""
        for b in batches:
            out = []
            for bundle, number, begin, size in zip(*[b.column(i).to_pylist() for i in at]):
                if (bundle, number) != opened:
                    with fs.open_input_file(f"{root}/{bundle}") as file:
                        if bundle not in tables:
                            tables = {bundle: read_seek_table(file)}
                        start, packed, full = tables[bundle][number]
                        file.seek(start)
                        frame = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=full)
                    opened = (bundle, number)
                found = content(frame[begin : begin + size])
                out.append(found.decode() if found is not None else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*fields, name])

    return map_rows(index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "begin"), run, [StructField(name, StringType())])


def bundled(pages: DataFrame) -> DataFrame:
    """The index of bundles in a new folder of the shared one, which goes when the driver ends."""
    folder = f"{shared_dir(pages.sparkSession)}/quillon/bundles-{uuid.uuid4().hex}"
    removed_at_exit(pages.sparkSession, folder)
    return write(pages, folder)
