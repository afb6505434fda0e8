"""The folder that all executors share, and small files in it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it isn't set, a session whose executors are this very process (tests, one machine) gets a folder in Spark's own; on a cluster it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = f"file://{spark.sparkContext._temp_dir}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Under another name first: who reads meanwhile finds the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    out = place.getFileSystem(conf).create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(temp, place, options)
