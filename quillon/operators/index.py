"""The stored index: tables in Parquet, a manifest written last, what has changed since, and its upkeep.

An index is a folder with versions. A version has the tables of all files; each update after it is a delta: the files that are gone or
changed, and the rows of those that are new. Readers see the version and the deltas that the manifest names, so what is being written can't be
seen, and a failed build or update leaves the index as it was. ``compacted`` makes a version of what is there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import symbols as sym
from quillon.operators import trigrams
from quillon.operators.search import Engine, file_scores
from quillon.sources import files as sources
from quillon.sources.storage import write_text

VERSION = 3
#: Tables with rows of one file each, and those that are made from all of them.
OF_FILES, OF_ALL = ("files", "postings", "symbols", "imports"), ("edges", "file_meta")


def fingerprint(paths: Sequence[str], extensions: Sequence[str] = (), exclude: Sequence[str] = (), most_bytes: int = 0, exclude_files: Sequence[str] = (), transcode: bool = True) -> str:
    """A hash of what decides which files are in an index, whatever the order it is given in."""
    norm = lambda xs: sorted(x.replace("\\", "/") for x in xs)
    text = json.dumps([norm(paths), sorted(x.lower() for x in extensions), norm(exclude), most_bytes, norm(exclude_files), transcode])
    return hashlib.md5(text.encode()).hexdigest()


def _write_lists(lists: DataFrame, at: str) -> None:
    """Small pages: a lookup of a few trigrams reads a few pages of each segment."""
    lists.write.option("parquet.page.row.count.limit", 256).parquet(at)


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{at}/{name}")
    return trigrams.of_lists(found) if name == "postings" else found


def _write_tables(files: DataFrame, at: str) -> None:
    """The tables of files. Each is computed from those already written, not from the source again."""
    spark = files.sparkSession
    files.select("file_id", "path", "content").write.parquet(f"{at}/files")
    files = spark.read.parquet(f"{at}/files")
    _write_lists(trigrams.lists(files), f"{at}/postings")
    sym.extract(files).write.parquet(f"{at}/extracted")
    extracted = spark.read.parquet(f"{at}/extracted")
    sym.symbol_table(extracted).write.parquet(f"{at}/symbols")
    sym.import_table(extracted).write.parquet(f"{at}/imports")


def _write_links(now: dict[str, DataFrame], at: str) -> None:
    """The tables that are made from the imports and symbols of all files."""
    spark = now["files"].sparkSession
    sym.edges(now["imports"], now["files"]).write.parquet(f"{at}/edges")
    file_scores(now["files"], now["symbols"], spark.read.parquet(f"{at}/edges")).write.parquet(f"{at}/file_meta")


def save(files: DataFrame, folder: str, config: str = "") -> None:
    """Builds all tables of an index and writes them as a new version; the manifest comes last."""
    spark = files.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    at = f"{folder}/{version}"
    _write_tables(files, at)
    _write_links({t: _table(spark, at, t) for t in OF_FILES}, at)
    write_text(spark, f"{folder}/manifest.json", json.dumps({"version": VERSION, "config": config, "base": version, "deltas": []}))


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an index as they are now."""
    known = manifest(spark, folder)
    if known["version"] != VERSION:
        raise ValueError(f"index version {known['version']}, expected {VERSION}")
    out = {t: _table(spark, f"{folder}/{known['base']}", t) for t in (*OF_FILES, *OF_ALL)}
    for delta in known["deltas"]:
        at = f"{folder}/{delta}"
        gone = spark.read.parquet(f"{at}/gone")
        for t in OF_FILES:
            out[t] = out[t].join(gone, "file_id", "left_anti").unionByName(_table(spark, at, t))
        for t in OF_ALL:
            out[t] = spark.read.parquet(f"{at}/{t}")
    return out


def load(spark: SparkSession, folder: str, roots: Sequence[str] = (), config: str | None = None) -> Engine:
    """The index of a folder; ValueError where it is of another version or configuration."""
    now = tables(spark, folder)
    if config is not None and manifest(spark, folder)["config"] != config:
        raise ValueError("the index was built with another configuration")
    return Engine(now["files"], now["symbols"], now["edges"], now["postings"], roots, meta=now["file_meta"])


def of_paths(spark: SparkSession, roots: Sequence[str], folder: str, **options) -> Engine:
    """The index of the text files under some paths, built when it is asked for. options: of ``sources.discover``."""
    save(sources.load(spark, roots, **options), folder, fingerprint(roots))
    return load(spark, folder, roots)


def update(spark: SparkSession, folder: str, changes: DataFrame) -> None:
    """Applies a log of changes (see ``upserted``) to a stored index, as a delta: what is written follows what changed, but for edges and scores.

    A file keeps its id as long as its path is there. Imports of other files are resolved again, since a new file may be what they stand for.
    """
    known, now = manifest(spark, folder), tables(spark, folder)
    delta = f"d-{uuid.uuid4().hex}"
    at = f"{folder}/{delta}"
    last_changes(changes).write.parquet(f"{at}/changes")
    last = spark.read.parquet(f"{at}/changes")
    of = now["files"].select("path", F.col("file_id").alias("old"))
    last.join(of, "path").select(F.col("old").alias("file_id")).write.parquet(f"{at}/gone")
    _write_tables(_fresh(last, of), at)
    gone = spark.read.parquet(f"{at}/gone")
    for t in OF_FILES:
        now[t] = now[t].join(gone, "file_id", "left_anti").unionByName(_table(spark, at, t))
    _write_links(now, at)
    write_text(spark, f"{folder}/manifest.json", json.dumps({**known, "deltas": [*known["deltas"], delta]}))


def compacted(spark: SparkSession, folder: str) -> None:
    """The version and its deltas become one version."""
    known, now = manifest(spark, folder), tables(spark, folder)
    version = f"v-{uuid.uuid4().hex}"
    for t, df in now.items():
        if t != "postings":
            df.write.parquet(f"{folder}/{version}/{t}")
    # From the files again: cheaper than to sort all postings.
    _write_lists(trigrams.lists(spark.read.parquet(f"{folder}/{version}/files")), f"{folder}/{version}/postings")
    write_text(spark, f"{folder}/manifest.json", json.dumps({**known, "base": version, "deltas": []}))


def reconcile(persisted: DataFrame, present: DataFrame, removed_bases: Sequence[str] = ()) -> DataFrame:
    """(path, status): Valid, Stale (another time or size), Removed (gone, or its base is) or New.

    Both have path, mtime and size; persisted also has source_base_path.
    """
    old = persisted.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), "source_base_path", F.lit(True).alias("old"))
    new = present.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("new"))
    gone = F.col("new").isNull()
    if removed_bases:
        gone = gone | F.coalesce(F.col("source_base_path").isin(list(removed_bases)), F.lit(False))
    status = F.when(F.col("old").isNull(), "New").when(gone, "Removed").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "Stale").otherwise("Valid")
    return old.join(new, "path", "full_outer").select("path", status.alias("status"))


def not_indexed(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """Discovered files that the index doesn't have."""
    return discovered.join(indexed.select("path"), "path", "left_anti")


def paths_diff(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): roots to add and roots to remove."""
    added = wanted.select("path").distinct().join(known, "path", "left_anti").withColumn("change", F.lit("add"))
    return added.unionByName(known.select("path").distinct().join(wanted, "path", "left_anti").withColumn("change", F.lit("remove")))


def remapped(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with new ids (old_id, new_id); those with an end that is gone are dropped."""
    a, b = ids.select(F.col("old_id").alias("from_id"), F.col("new_id").alias("a")), ids.select(F.col("old_id").alias("to_id"), F.col("new_id").alias("b"))
    return links.join(a, "from_id").join(b, "to_id").select(F.col("a").alias("from_id"), F.col("b").alias("to_id")).distinct()


def last_changes(changes: DataFrame) -> DataFrame:
    """(path, op, content): the last change of each path."""
    return changes.groupBy("path").agg(F.max_by(F.struct("op", "content"), F.struct("ts", "seq")).alias("c")).select("path", "c.*")


def _fresh(last: DataFrame, known: DataFrame) -> DataFrame:
    """The files that changes leave, with the ids (old) of their paths where they had one."""
    new = F.xxhash64("path").bitwiseAND((1 << 62) - 1)
    kept = last.filter("op <> 'deleted' and content is not null").join(known, "path", "left")
    return kept.select(F.coalesce("old", new).alias("file_id"), "path", "content")


def upserted(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` after a log of changes (path, op, ts, seq, content): the last change of a path counts; a deleted file is gone, and so is one without content.

    A file keeps its id; a new one's is a hash of its path.
    """
    last = last_changes(changes)
    kept = files.join(last.select("path"), "path", "left_anti")
    fresh = _fresh(last, files.select("path", F.col("file_id").alias("old")))
    return kept.select("file_id", "path", "content").unionByName(fresh)
