"""Keeping an index current with Structured Streaming.

A stream of changes (path, op, ts, seq, content) is appended to a log in Parquet, a folder for each batch that a repeated
batch overwrites, so each change is there once. The current files are a view: the base less what the log changed, plus the
last state of each path. Compaction writes the view as the next base; ``index.update`` takes a log into a stored index.

``watched`` is a stream of files that appear. Files that change or go away leave no trace in such a stream, so ``Watcher`` compares the listing
of each batch with that of the batch before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from quillon.functions import paths
from quillon.operators import index
from quillon.sources import files as sources

CHANGE = "path string, op string, ts timestamp, seq bigint, content string"


def _texts(raw: DataFrame) -> DataFrame:
    """Files with modificationTime and content as changes. A file that has no readable text counts as one that isn't there."""
    text = sources.prepared(raw, keep=["modificationTime"])
    op = F.when(F.col("reason").isNull(), "modified").otherwise("deleted")
    return text.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), op.alias("op"), F.col("modificationTime").alias("ts"), F.unix_micros("modificationTime").alias("seq"), "content")


def watched(spark: SparkSession, folder: str, exclude: Sequence[str] = (), per_trigger: int = 500) -> DataFrame:
    """Files of a folder as they appear, as changes, in any character set that ``sources`` reads. How many are taken at once bounds a batch."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return _texts(raw.filter(~paths.watched_out("path", exclude) & ~paths.has_binary_extension("path")))


class Watcher:
    """New, changed and removed files under some folders, batch by batch.

    state: a folder for the listings. That of a batch is written when its changes are in the log, and read by the next one, so a batch that is
    run again finds the same changes.
    """

    def __init__(self, spark: SparkSession, roots: Sequence[str], log: str, state: str, exclude: Sequence[str] = ()) -> None:
        self.spark, self.roots, self.log, self.state, self.exclude = spark, list(roots), log, state, exclude

    def _raw(self) -> DataFrame:
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.roots)
        return raw.filter((F.col("length") <= sources.MOST_BYTES) & ~paths.watched_out("path", self.exclude) & ~paths.has_binary_extension("path"))

    def changes(self, number: int) -> tuple[DataFrame, DataFrame]:
        """The changes since the listing of the last batch before ``number``, and the listing as it is now. Contents are read of new and changed files only."""
        now = self._raw().select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))
        now.write.mode("overwrite").parquet(f"{self.state}/next")
        now = self.spark.read.parquet(f"{self.state}/next")
        before = self.spark.read.schema("path string, mtime bigint, size bigint, batch bigint").parquet(self.state + "/listings") if self._known() else None
        if before is not None:
            earlier = before.filter(F.col("batch") < number)
            last = earlier.agg(F.max("batch")).first()[0]
            before = earlier.filter(F.col("batch") == last).drop("batch") if last is not None else None
        if before is None:
            before = now.limit(0)
        status = index.reconcile(before.withColumn("source_base_path", F.lit("")), now).filter("status <> 'Valid'")
        fresh = status.filter("status in ('New', 'Stale')").select("path")
        since = now.join(fresh, "path", "left_semi").agg(F.min("mtime")).first()[0]
        # Files older than all that changed aren't opened: the scan knows their times.
        raw = self._raw().filter(F.col("modificationTime") >= F.timestamp_micros(F.lit(since))) if since is not None else self._raw().limit(0)
        gone = status.filter("status = 'Removed'").select(
            F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit("deleted").alias("op"), F.current_timestamp().alias("ts"), F.unix_micros(F.current_timestamp()).alias("seq"), F.lit(None).cast("string").alias("content")
        )
        return _texts(raw.join(fresh, "path", "left_semi")).unionByName(gone), now

    def _known(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/listings")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def batch(self, number: int) -> None:
        """Writes the changes into the log. A later batch's change counts, whatever the clocks of files say."""
        found, now = self.changes(number)
        found.withColumn("seq", F.lit(number).cast("bigint")).withColumn("ts", F.timestamp_seconds(F.lit(number))).write.mode("overwrite").parquet(f"{self.log}/batch={number}")
        now.write.mode("overwrite").parquet(f"{self.state}/listings/batch={number}")

    def start(self, checkpoint: str, every: str) -> StreamingQuery:
        """A stream that looks every so often."""
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, number: self.batch(number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def log_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files of changes as a stream."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def apply_to_log(changes: DataFrame, log: str, checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """Appends a stream of changes to a log. every: a time between batches, such as "2 seconds"; without it, what is there is taken once."""

    def batch(df: DataFrame, number: int) -> None:
        # The last change of a path within a batch is enough; a batch that is run again replaces itself.
        last = df.groupBy("path").agg(F.max_by(F.struct("op", "ts", "seq", "content"), F.struct("ts", "seq")).alias("c"))
        last.select("path", "c.*").write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def current(files: DataFrame, log: str) -> DataFrame:
    """The files after all changes of the log."""
    return index.upserted(files, files.sparkSession.read.schema(CHANGE + ", batch bigint").parquet(log))


def compacted(files: DataFrame, log: str, folder: str) -> DataFrame:
    """The current files written as a new base."""
    current(files, log).write.mode("overwrite").parquet(folder)
    return files.sparkSession.read.parquet(folder)


class Progress(StreamingQueryListener):
    """The states of the streams of a session, for a status page."""

    def __init__(self) -> None:
        self.rows: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = {"status": "Running", "files": 0, "batches": 0}

    def onQueryProgress(self, event) -> None:
        row = self.rows.setdefault(str(event.progress.id), {"status": "Running", "files": 0, "batches": 0})
        row["files"] += event.progress.numInputRows
        row["batches"] += 1

    def onQueryIdle(self, event) -> None:
        self.rows.setdefault(str(event.id), {"files": 0, "batches": 0})["status"] = "Idle"

    def onQueryTerminated(self, event) -> None:
        self.rows.setdefault(str(event.id), {"files": 0, "batches": 0})["status"] = "Failed" if event.exception else "Completed"
